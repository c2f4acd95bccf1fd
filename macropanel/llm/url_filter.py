"""Operator 13: URL filter by rules and the ratio of two character models.

Rules accept or reject whole hosts and paths. What no rule decides is judged by two smoothed variable-order Markov
models over the bytes of the URL, one of all accepted and one of all rejected URLs: the probability of a byte after
its last `order` bytes blends those of all shorter contexts (Witten-Bell: a context weighs as many escapes as it has
had different followers, an unseen one passes on to the next shorter). The score of a URL is the difference of the
log-likelihoods over its bytes and its end, divided by their number. The threshold is calibrated on the accepted and
rejected URLs, each scored by models of the other half of them: the one with the least balanced error.

Every URL counts, and the models grow with the table, so they are tables themselves: each n-gram of `order` + 1 bytes
(a long) with its counts by class and half, and from these the three differences that scores add up. Rows are dealt to
batches; a batch asks for each of its distinct n-grams once, so that an n-gram of all URLs costs one row a batch.
Differences are whole millionths, so sums don't depend on their order. The driver sees a histogram of at most `BINS` bins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import land, raw_texts, table

BATCH = 16_384  # URLs of a batch, which is held in memory ...
PIECE = 4_000_000  # ... or so many bytes, or one longer URL
UNIT = 1_000_000  # differences are whole parts of a nat
GRID = 100  # scores are compared by hundredths of a nat
BINS = 20_001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = ("a0", "a1", "r0", "r1")  # accepted and rejected, by half
MODELS = {"a": ("a0", "a1"), "r": ("r0", "r1"), **{c: (c,) for c in COUNTS}}
#: What scores add up: all URLs judged by all, half 0 by models of half 1, half 1 by models of half 0.
RATIOS = {"whole": ("a", "r"), "half0": ("a1", "r1"), "half1": ("a0", "r0")}

#: (verdict, host and path) of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule(rules, of_host: Column, of_path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first given), and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((of_host == domain) | of_host.endswith("." + domain)) & of_path.startswith("/" + start)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def grams(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of each byte and of the end of each URL, and how many each URL has. Before its start stand zeros."""
    begin, end, data = raw_texts(batch.column("url"))
    size = end - begin
    whole = size + order + 1
    start = np.cumsum(whole) - whole
    text = np.zeros(int(whole.sum()), np.uint64)
    if size.sum():
        place = np.repeat(start + order - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        text[place] = np.frombuffer(data, np.uint8)[begin[0] : end[-1]]
    n = size + 1
    first = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    out = np.zeros(len(first), np.uint64)
    for j in range(order + 1):
        out = (out << np.uint64(8)) | text[first + j]
    return out.astype(np.int64), n


def _batched(rows: DataFrame) -> DataFrame:
    """`rows` with the number of the batch that they are dealt to."""
    kind = ", ".join(f"{n} {t}" for n, t in [*rows.dtypes, ("batch", "bigint")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            begin, end, _ = raw_texts(batch.column("url"))
            at = 0
            while at < batch.num_rows:
                upto = min(at + BATCH - count, int(np.searchsorted(end, begin[at] + PIECE - size, side="right")))
                if upto > at or not count:
                    upto = max(upto, at + 1)
                    part = batch.slice(at, upto - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, number))], names=[*batch.schema.names, "batch"])
                    count, size, at = count + part.num_rows, size + int(end[upto - 1] - begin[at]), upto
                if at < batch.num_rows or count >= BATCH:
                    number, count, size = number + 1, 0, 0

    return rows.mapInArrow(run, kind)


def _asked(rows: DataFrame, order: int) -> DataFrame:
    """`(batch, gram)` with the counts of each n-gram among the accepted and rejected URLs of the batch, by half."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def asked() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram, n = grams(whole, order)
            known, at = np.unique(gram, return_inverse=True)
            column = np.repeat(whole.column("model").to_numpy(), n)  # 0 to 3 as in COUNTS, -1 for none
            counts = [np.bincount(at[column == i], minlength=len(known)) for i in range(len(COUNTS))]
            number = pa.array(np.full(len(known), whole.column("batch")[0].as_py()))
            yield pa.RecordBatch.from_arrays([number, pa.array(known), *(pa.array(c.astype(np.int64)) for c in counts)], names=["batch", "gram", *COUNTS])

        for batch in batches:
            number = batch.column("batch").to_numpy()
            for at in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                if len(at):
                    if held and held[0].column("batch")[0].as_py() != number[at[0]]:
                        yield from asked()
                        held = []
                    held.append(batch.slice(int(at[0]), len(at)))
        yield from asked()

    return rows.select("url", "model", "batch").mapInArrow(run, "batch long, gram long, " + ", ".join(f"{c} long" for c in COUNTS))


def _ratios(counts: DataFrame, order: int) -> DataFrame:
    """The differences of the log-probabilities of each n-gram's last byte, as `RATIOS` names them."""
    before = None
    for length in range(order + 1):  # of the context
        cut = (1 << 8 * (length + 1)) - 1
        level = counts.groupBy(F.col("gram").bitwiseAND(cut).alias("gram")).agg(*(F.sum(c).alias(c) for c in COUNTS))
        level = level.select("gram", *(reduce(lambda x, y: x + y, map(F.col, parts)).cast("double").alias(m) for m, parts in MODELS.items()))
        same = Window.partitionBy(F.shiftright("gram", 8))  # at most 256 rows
        seen = [F.sum(m).over(same).alias(f"n_{m}") for m in MODELS] + [F.sum((F.col(m) > 0).cast("double")).over(same).alias(f"t_{m}") for m in MODELS]
        level = level.select("*", *seen)
        if before is None:
            level = level.select("*", *(F.lit(1 / 256).alias(f"p_{m}") for m in MODELS))
        else:
            shorter = before.withColumnRenamed("gram", "tail")
            level = level.join(shorter, F.col("gram").bitwiseAND((1 << 8 * length) - 1) == F.col("tail"))
        blend = {m: (F.col(m) + F.col(f"t_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"t_{m}")) for m in MODELS}
        before = level.select("gram", *(F.when(F.col(f"n_{m}") > 0, p).otherwise(F.col(f"p_{m}")).alias(f"p_{m}") for m, p in blend.items()))
    whole = {n: F.floor((F.ln(f"p_{a}") - F.ln(f"p_{r}")) * UNIT + 0.5).cast("long").alias(n) for n, (a, r) in RATIOS.items()}
    return before.select("gram", *whole.values())


def _scored(rows: DataFrame, answers: DataFrame, order: int, kind: str) -> DataFrame:
    """`rows` with `n` places and the sums of what `answers` has for their n-grams."""
    names = [c.split()[0] for c in kind.split(", ")]

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        batch = own.combine_chunks().to_batches()[0]
        gram, n = grams(batch, order)
        known, first = np.unique(found["gram"].to_numpy(), return_index=True)
        at = first[np.searchsorted(known, gram)]
        start = np.cumsum(n) - n
        sums = [np.add.reduceat(found[r].to_numpy()[at], start) for r in RATIOS]
        columns = {**{c: batch.column(c) for c in batch.schema.names}, "n": pa.array(n), **{r: pa.array(s) for r, s in zip(RATIOS, sums)}}
        return pa.table({c: columns[c] for c in names})

    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, kind)


def _bin(score: Column) -> Column:
    edge = BINS // 2
    return F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(score * GRID).cast("int")))


def threshold(labelled: DataFrame) -> int | None:
    """The bin from which on URLs are accepted, from `(bin, accepted)`; None without accepted or rejected URLs.

    The least sum of both classes' shares of wrong verdicts; of equal ones the nearest to 0, then the smaller.
    """
    found = {True: {}, False: {}}
    for r in labelled.groupBy("bin", "accepted").count().collect():  # at most 2 x BINS
        found[r.accepted][r.bin] = r["count"]
    a, r = sum(found[True].values()), sum(found[False].values())
    if not a or not r:
        return None
    bins = sorted(found[True].keys() | found[False].keys())
    best, wrong = None, r * a  # all accepted: all rejected ones are wrong
    for t in sorted({*bins, bins[-1] + 1, 0}):
        wrong = r * sum(n for b, n in found[True].items() if b < t) + a * sum(n for b, n in found[False].items() if b >= t)
        best = min(best or (wrong, abs(t), t), (wrong, abs(t), t))
    return best[2]


def judge_urls(pages: DataFrame, rules=RULES, *, order: int = 5) -> DataFrame:
    """`page_id, host, path, rule, verdict, score` of every row of `pages`.

    `score` is in nats a byte (positive: likelier accepted); `order` at most 6. A null URL is empty: it has no host, no path
    and only its end to score. Rows with equal or no ids are judged each by itself, equal URLs alike. Where the
    rules accept none or reject none, nothing can be told apart and all others are allowed. An empty table gives no
    rows. Other columns are not looked at.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"))
    rows = rows.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule(rules, F.col("host"), F.col("path"))
    half = F.conv(F.substring(F.md5(F.col("url")), 1, 1), 16, 10).cast("int") % 2
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), half.alias("half"))
    model = F.when(F.col("ruled") == "allow", F.col("half")).when(F.col("ruled") == "block", F.col("half") + 2).otherwise(-1)
    rows = land(_batched(rows.withColumn("model", model.cast("int"))))
    asked = land(_asked(rows, order))
    counts = land(asked.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    answers = asked.select("batch", "gram").join(_ratios(counts, order), "gram")
    of_id = dict(rows.dtypes)["page_id"]
    kind = f"page_id {of_id}, host string, path string, rule string, ruled string, half int, n long, whole long, half0 long, half1 long"
    scored = land(_scored(rows, answers, order, kind))
    crossed = F.when(F.col("half") == 0, F.col("half0")).otherwise(F.col("half1"))
    cut = threshold(scored.where("ruled is not null").select(_bin(crossed / F.lit(UNIT) / F.col("n")).alias("bin"), (F.col("ruled") == "allow").alias("accepted")))
    score = F.col("whole") / F.lit(UNIT) / F.col("n")
    judged = F.lit("allow") if cut is None else F.when(_bin(score) >= cut, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), score.alias("score"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


def _sql(rules=RULES, order: int = 5) -> str:
    name = verdict = "null"
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = f"(host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '/{start}')"
        name, verdict = f"case when {fits} then '{text}' else {name} end", f"case when {fits} then '{what}' else {verdict} end"
    levels = []
    for k in range(order + 1):
        sums = ", ".join(f"sum({' + '.join(parts)})::double as {m}" for m, parts in MODELS.items())
        levels.append(f"l{k} as (select right(g, {2 * k + 2}) as g, {sums} from counts group by 1)")
        seen = ", ".join(f"sum({m}) over w as n_{m}, sum((({m}) > 0)::int::double) over w as t_{m}" for m in MODELS)
        levels.append(f"w{k} as (select *, {seen} from l{k} window w as (partition by left(g, {2 * k})))")
        before = {m: f"p.p_{m}" if k else "1 / 256::double" for m in MODELS}
        blend = ", ".join(f"case when n_{m} > 0 then ({m} + t_{m} * {before[m]}) / (n_{m} + t_{m}) else {before[m]} end as p_{m}" for m in MODELS)
        levels.append(f"p{k} as (select w.g, {blend} from w{k} w" + (f" join p{k - 1} p on p.g = right(w.g, {2 * k}))" if k else ")"))
    ratios = ", ".join(f"floor((ln(p_{a}) - ln(p_{r})) * {UNIT} + 0.5)::bigint as {n}" for n, (a, r) in RATIOS.items())
    counts = ", ".join(f"count(*) filter (where model = {i}) as {c}" for i, c in enumerate(COUNTS))
    return rf"""
with cut as (select page_id, coalesce(url, '') as u, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select row_number() over () as id, page_id, u, host, path, {name} as rule, {verdict} as ruled,
  case when md5(u)[1] in ('0', '2', '4', '6', '8', 'a', 'c', 'e') then 0 else 1 end as half from parts),
modelled as (select *, case ruled when 'allow' then half when 'block' then half + 2 else -1 end as model,
  '{"00" * order}' || hex(encode(u)) || '00' as bytes from ruled),
places as (select id, model, substr(bytes, 2 * i + 1, {2 * order + 2}) as g from (select *, unnest(range(0, len(bytes) // 2 - {order})) as i from modelled)),
counts as (select g, {counts} from places group by g),
{", ".join(levels)},
ratios as (select g, {ratios} from p{order}),
scored as (
  select id, count(*) as n, sum(whole)::double / {UNIT} / count(*) as score, sum(half0)::double / {UNIT} / count(*) as score0, sum(half1)::double / {UNIT} / count(*) as score1
  from places join ratios using (g) group by id),
binned as (select r.*, floor(score * {GRID})::int as bin, floor(case when half = 0 then score0 else score1 end * {GRID})::int as crossed from ruled r join scored using (id)),
labelled as (select crossed, ruled = 'allow' as accepted from binned where ruled is not null),
edges as (select distinct crossed as t from labelled union select max(crossed) + 1 from labelled union select 0),
best as (
  select arg_min(t, (wrong, abs(t), t)) as t from (
    select t, count(*) filter (where accepted and crossed < t) * (select count(*) from labelled where not accepted)
      + count(*) filter (where not accepted and crossed >= t) * (select count(*) from labelled where accepted) as wrong
    from edges cross join labelled group by t)
  where (select count(distinct accepted) from labelled) = 2)
select page_id, host, path, rule, coalesce(ruled, case when t is null or bin >= t then 'allow' else 'block' end) as verdict from binned cross join best"""


OP13_SQL = _sql()
