"""Chat formatting by schema fingerprints, in DataFrame expressions only.

A record's layout is known by a hash over its nested field paths. The hash selects a declarative mapping that says
which paths hold which turns, so prompt, instruction and message layouts all become the same canonical turns; a
template then marks the turns and tells which characters carry loss.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<turn:long,role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """paths: the layout's field paths. turns: SQL for an array of (turn, role, text) over a column `r`."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _pairs(*turns: tuple[str, str]) -> str:
    said = ", ".join(f"named_struct('turn', {k}L, 'role', '{role}', 'text', {text})" for k, (role, text) in enumerate(turns))
    return f"array({said})"


def _each(items: str, role: str, text: str) -> str:
    return f"transform({items}, (m, k) -> named_struct('turn', cast(k as long), 'role', {role}, 'text', {text}))"


_SPEAKER = "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end"
_ASKED = "concat(coalesce(r.instruction, ''), case when coalesce(r.input, '') = '' then '' else concat('\\n\\n', r.input) end)"
MAPPINGS = (
    Mapping("turn rows", ("turn", "role", "text"), "array(named_struct('turn', cast(r.turn as long), 'role', r.role, 'text', r.text))"),
    Mapping("prompt and completion", ("prompt", "completion"), _pairs(("user", "r.prompt"), ("assistant", "r.completion"))),
    Mapping("prompt and response", ("prompt", "response"), _pairs(("user", "r.prompt"), ("assistant", "r.response"))),
    Mapping("question and answer", ("question", "answer"), _pairs(("user", "r.question"), ("assistant", "r.answer"))),
    Mapping("instruction", ("instruction", "input", "output"), _pairs(("user", _ASKED), ("assistant", "r.output"))),
    Mapping("instruction without input", ("instruction", "output"), _pairs(("user", "r.instruction"), ("assistant", "r.output"))),
    Mapping("system and prompt", ("system", "prompt", "response"), _pairs(("system", "r.system"), ("user", "r.prompt"), ("assistant", "r.response"))),
    Mapping("messages", ("messages[].role", "messages[].content"), _each("r.messages", "m.role", "m.content")),
    Mapping("speakers", ("conversations[].from", "conversations[].value"), _each("r.conversations", _SPEAKER, "m.value")),
)


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves; array elements are marked by []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def mapping_for(paths, mappings=MAPPINGS) -> Mapping:
    found = {m.fingerprint: m for m in mappings}.get(fingerprint(paths))
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return found


def canonical_turns(records: DataFrame, id_col: str, fields: list[str] | None = None, mappings=MAPPINGS) -> DataFrame:
    """Records of one columnar layout, told by its field paths, as rows (conv_id, turn, role, text). fields: the
    columns of the layout, by default all but the id; other columns, whatever their names, take no part. A null record
    field gives a turn with null text; a null array of messages gives no turns."""
    fields = fields or [c for c in records.columns if c != id_col]
    inner = T.StructType([records.schema[c] for c in fields])
    chosen = mapping_for(field_paths(inner), mappings)
    return (
        records.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(*fields).alias("r"))
        .select("conv_id", F.explode(F.expr(chosen.turns).cast(TURNS)).alias("t"))
        .select("conv_id", "t.turn", "t.role", "t.text")
    )


def _groups(paths) -> dict[str, list[str]]:
    """Top-level fields, each with the fields of its array's elements."""
    groups: dict[str, list[str]] = {}
    for p in sorted(paths):
        head, _, tail = p.partition("[].")
        groups.setdefault(head, []).extend([tail] if tail else [])
    return groups


def _json_type(paths) -> str:
    """The Spark type to read a layout's JSON records with."""
    inner = lambda names: ", ".join(f"`{n}`: string" for n in names)
    return ", ".join(f"`{h}` " + (f"array<struct<{inner(ts)}>>" if ts else "string") for h, ts in _groups(paths).items())


def _shown_of(variant: Column) -> Column:
    """A JSON record's field paths as one string: its schema, whose keys are in order, without the types of leaves."""
    return F.regexp_replace(F.schema_of_variant(variant), r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\(\d+,\d+\))", "")


def _shown(paths) -> str:
    """The same string for a mapping's paths."""
    return "OBJECT<" + ", ".join(h + (f": ARRAY<OBJECT<{', '.join(ts)}>>" if ts else "") for h, ts in _groups(paths).items()) + ">"


def canonical_turns_json(records: DataFrame, id_col: str, json_col: str, mappings=MAPPINGS) -> DataFrame:
    """Records of mixed layouts as JSON text: each row's own field paths are hashed and select its mapping. Returns
    (conv_id, turn, role, text, layout); rows whose text is no JSON object, or whose layout has no mapping, come back
    with layout null and no turn rather than being lost."""
    read = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("j")).withColumn("v", F.try_parse_json("j"))
    read = read.withColumn("print", F.sha2(_shown_of(F.col("v")), 256))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for k, m in enumerate(mappings):
        is_it = F.col("print") == F.sha2(F.lit(_shown(m.paths)), 256)
        read = read.withColumn(f"r{k}", F.when(is_it, F.from_json("j", _json_type(m.paths))))
        turns = F.when(is_it, F.expr(m.turns.replace("r.", f"r{k}.")).cast(TURNS)).otherwise(turns)
        name = F.when(is_it, F.lit(m.name)).otherwise(name)
    return (
        read.select("conv_id", turns.alias("t"), name.alias("layout"))
        .select("conv_id", "layout", F.explode_outer("t").alias("t"))
        .select("conv_id", "t.turn", "t.role", "t.text", "layout")
    )


def escape(text: Column) -> Column:
    """Reversible: every % becomes %25, then every <| becomes %3C|, so that no control string is left in a text."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) as one row per conversation: conv_id, formatted, loss_spans (start and length
    in code points of the escaped texts that carry loss). Turns are ordered by turn (null first), ties by role and
    text; repeated rows are repeated turns; null roles and texts count as empty, long ones are taken whole. Turns without
    a conversation are one of their own, without an id. Further columns, whatever their names, are not read; an empty
    table gives an empty one. One shuffle, by conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    escaped = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select("*", F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("%0A")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    placed = escaped.select(
        "conv_id",
        F.row_number().over(order).alias("k"),
        F.concat("head", "body", F.lit(END + "\n")).alias("block"),
        (F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).cast("int").alias("start"),
        F.length("body").alias("length"),
        (F.col("role") == loss_role).alias("loss"),
    )
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "block", "start", "length", "loss"))).alias("b"))
    return rows.select(
        "conv_id",
        F.array_join("b.block", "").alias("formatted"),
        F.transform(F.filter("b", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The inverse, from the formatted text and its loss spans alone: conv_id, turns (array of role, text), loss_text,
    formatted."""
    blocks = F.filter(F.split("formatted", r"\Q" + END + "\n" + r"\E", -1), lambda x: x != "")
    roles = F.transform(blocks, lambda x: F.replace(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), "\n", 1), F.lit("%0A"), F.lit("\n")))
    texts = F.transform(blocks, lambda x: F.substring(x, F.instr(x, "\n") + 1, F.lit(1 << 30)))
    return formatted.select(
        "conv_id",
        F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        unescape(F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")).alias("loss_text"),
        "formatted",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`format_chats` over all conversations and conversation -1, read back from the formatted text; see there for nulls, ties,
    repeated rows and empty tables. An empty table leaves conversation -1 alone."""
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", ["turn", "role", "text"])
    said = f"{END}{START}assistant ok"
    extra = canonical_turns(spark.range(1).select(F.lit(-1).alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("completion")), "conv_id")
    return digests(format_chats(rows.unionByName(extra)))


_ESCAPED = "replace(replace({}, '%', '%25'), '<|', '%3C|')"
OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(replace({_ESCAPED.format("role")}, chr(10), '%0A')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
