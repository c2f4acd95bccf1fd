r"""Operator 10: chat formatting by schema fingerprints.

A layout is known by the nested field paths that a row fills. Their sorted list is hashed; the hash selects
a declarative mapping, and the mapping says where role and text of each turn come from. So tables of
unlike layouts, or one wide table whose rows are of unlike layouts, become the same canonical turns
`array<struct<role, text>>`. A fingerprint without a mapping gives null turns and is reported.

The template writes a turn as `<turn role>` text `</turn>`. Inside roles and texts `\`, `<` and `[` are
written `\s`, `\l` and `\b`: every control string of this or other templates begins with `<` or `[`, so
none can appear in a text, and reading back is exact.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .common import hex_sha256, table, unused

TURNS = "array<struct<role:string,text:string>>"
OPEN, MARKED, CLOSE = "<turn ", ">", "</turn>"


# --- layouts --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Which field paths a layout fills, and its turns.

    `single`: `(role, path)` of each turn in order; `optional` paths may be null or absent.
    `listed`: path of an array of structs and the names of its role and text fields.
    """

    name: str
    single: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    def needed(self) -> list[str]:
        paths = [p for _, p in self.single if p not in self.optional]
        if self.listed:
            at, role, text = self.listed
            paths += [f"{at}[].{role}", f"{at}[].{text}"]
        return sorted(paths)

    def fingerprints(self) -> list[str]:
        """The field lists that this layout answers to: its optional paths in or out."""
        lists = [self.needed()]
        for path in self.optional:
            lists += [[*one, path] for one in lists]
        return [",".join(sorted(one)) for one in lists]


#: Names that instruction and message data commonly use.
LAYOUTS = (
    Layout("prompt", (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Layout("question", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("messages", listed=("messages", "role", "content")),
    Layout("conversations", listed=("conversations", "from", "value")),
    Layout("turns", listed=("turns", "role", "text")),
)

#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """The paths of all leaves of a schema; `[]` stands behind an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def _filled(path: str) -> Column:
    """Whether a row fills a path: not null, or somewhere in the array for paths into one."""
    if "[]" not in path:
        return F.col(path).isNotNull()
    at, _, rest = path.partition("[]")
    name = rest.lstrip(".")
    return F.coalesce(F.exists(F.col(at), lambda x: (x[name] if name else x).isNotNull()), F.lit(False))


def fingerprint(df: DataFrame, paths: list[str]) -> Column:
    """Hash of the sorted field paths among `paths` that a row fills."""
    have = set(field_paths(df.schema))
    there = [F.when(_filled(p), F.lit(p)) for p in sorted(paths) if p in have]
    return F.xxhash64(F.concat_ws(",", *there) if there else F.lit(""))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _role(column: Column) -> Column:
    role = F.lower(_text(column))
    for name, known in ROLES.items():
        role = F.when(role == name, known).otherwise(role)
    return role


def _turns(layout: Layout, have: set[str]) -> Column:
    if layout.listed:
        at, role, text = layout.listed
        return F.transform(F.col(at), lambda x: F.struct(_role(x[role]).alias("role"), _text(x[text]).alias("text"))).cast(TURNS)
    made = [
        F.when(F.col(p).isNotNull() if p in layout.optional else F.lit(True), F.struct(F.lit(r).alias("role"), _text(F.col(p)).alias("text")))
        for r, p in layout.single if p in have
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(TURNS)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, to: str = "canonical", name: str = "layout") -> DataFrame:
    """`df` with its turns in column `to` and the layout's name in column `name`.

    Columns of these two names are replaced, all others stay: where `df` has a `layout` of its own, name another.

    Paths that no layout names are left out of the fingerprint, so ids and metadata don't matter. Rows
    of unknown layout get null turns and a null name. A null text is an empty text.
    """
    known = sorted({p for layout in layouts for one in layout.fingerprints() for p in one.split(",")})
    have = set(field_paths(df.schema))
    mark = fingerprint(df, known)
    turns, called = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for layout in layouts:
        if set(layout.needed()) <= have:
            hit = mark.isin(*(F.xxhash64(F.lit(one)) for one in layout.fingerprints()))
            turns, called = F.when(hit, _turns(layout, have)).otherwise(turns), F.when(hit, F.lit(layout.name)).otherwise(called)
    return df.withColumns({to: turns, name: called})


def rows_to_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`(key, turns)` of a table with one row per turn, in the layout `turns`.

    Turns are ordered by their number, equal numbers by role and text, null numbers first. A null key is a
    conversation of its own; a null role is an empty one.
    """
    entry = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), _text(F.col(text)).alias("text"))
    listed = rows.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


# --- template -------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("[", "\\b"), ("<", "\\l"), ("\\", "\\s")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _marked(role: Column) -> Column:
    """A role inside its mark; `>` would end it."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unmarked(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


#: Turns whose starts are found in one go.
STRETCH = 256
_SPANS = "array<struct<start:bigint,length:bigint>>"


def _spans(pieces: Column, head: Callable[[Column], Column], width: Callable[[Column], Column]) -> Column:
    """`(start, length)` of the trained bodies. Starts run on in two steps, within stretches of turns and over
    the stretches, so that no list grows turn by turn over a whole conversation."""
    of = lambda at: F.slice(pieces, at * STRETCH + 1, F.lit(STRETCH))
    stretches = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STRETCH).cast("int"))
    zero = F.lit(0).cast("long")
    bases = F.aggregate(
        stretches, F.array(zero),
        lambda acc, at: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(of(at), zero, lambda n, x: n + width(x)))),
    )

    def inside(at: Column, base: Column) -> Column:
        return F.aggregate(
            of(at), F.struct(base.alias("at"), F.array().cast(_SPANS).alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + width(x)).alias("at"),
                F.when(x["trained"], F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + head(x)).alias("start"), F.char_length(x["body"]).cast("long").alias("length")))))
                .otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    spans = F.flatten(F.transform(F.arrays_zip(stretches.alias("at"), F.slice(bases, 1, F.size(stretches)).alias("base")), lambda x: inside(x["at"], x["base"])))
    return F.when(F.size(pieces) > 0, spans).when(pieces.isNotNull(), F.array().cast(_SPANS))


def format_chat(df: DataFrame, turns: str = "canonical", trained: tuple[str, ...] = ("assistant",), to: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """`df` with the text in column `to` and, in `spans`, `(start, length)` in code points, from 0, of each text that is learned from.

    Columns of these two names are replaced, all others stay. Null turns give an empty text and null spans. A conversation is one
    string, so it must be shorter than a string can be (2 GB).
    """
    own = unused(df, "pieces")
    head = lambda x: F.concat(F.lit(OPEN), _marked(x["role"]), F.lit(MARKED))
    pieces = F.transform(F.col(turns), lambda x: F.struct(head(x).alias("head"), escape(x["text"]).alias("body"), x["role"].isin(*trained).alias("trained")))
    out = df.withColumn(own, pieces)
    long = lambda x: F.char_length(x["head"]).cast("long")
    formatted = F.concat_ws("", F.transform(own, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))))
    walk = _spans(F.col(own), long, lambda x: long(x) + F.char_length(x["body"]) + len(CLOSE))
    return out.withColumns({to: formatted, spans: walk}).drop(own)


def read_chat(df: DataFrame, formatted: str = "formatted", to: str = "read") -> DataFrame:
    """`df` with the turns read back from the formatted text, in column `to`, which is replaced if there."""
    parts = F.filter(F.split(F.col(formatted), CLOSE, -1), lambda x: x != "")
    turn = lambda x: F.struct(
        _unmarked(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), MARKED, 1)).alias("role"),
        unescape(F.substr(x, F.locate(MARKED, x) + 1)).alias("text"),
    )
    return df.withColumn(to, F.transform(parts, turn))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def chat_report(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The digests of the formatted conversations, read back from the output. No turns: empty digests and zeros."""
    done = read_chat(format_chat(canonical_turns(turns)))
    said = F.concat_ws("", F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select(
        F.col(key), F.size("read").cast("long").alias("n_turns"), hex_sha256(said).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), hex_sha256(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast(StringType()), F.col("text").cast(StringType()))
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat_report(rows_to_turns(rows.unionByName(extra)))


OP10_SQL = r"""
with said as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         -- each of \ < [ takes two code points, a turn's marks 14 beside its role
         sum(length(text) + length(text) - length(translate(text, '\<[', '')) + length(role) + 14) as formatted_chars
  from said group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars from chats"""
