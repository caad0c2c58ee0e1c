"""Chat formatting: records in any known layout become canonical turns, one marked-up text and the spans to learn from.

Built-in functions only.  A record is a JSON text.  Its layout is recognised by a fingerprint: the hash of the sorted nested
field paths, without types and nulls.  Each fingerprint selects a declarative mapping, a list of turns with a role and a
path, or a path to an array of turns with the names of its role and text fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import at_place, named, numbered

#: Marks of the template.  Each turn is START role MIDDLE text END.
START, MIDDLE, END = "<|turn|>", "<|text|>", "<|done|>"
#: Strings that no text or role may show unescaped: an escaped one has a backslash after its first character, and every
#: backslash of the text itself is doubled.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "array<struct<role:string,text:string>>"
#: A variant holds no string above some 20 million characters and 128 MB in all; shorter records than this cannot reach that.
LONG = 8_000_000
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Fields:
    """A layout with one field per turn: (role, field, required); a null or missing optional field makes no turn."""

    turns: tuple[tuple[str, str, bool], ...]

    def paths(self) -> list[tuple[str, ...]]:
        optional = [f for _, f, required in self.turns if not required]
        needed = [f for _, f, required in self.turns if required]
        return [tuple(sorted(needed + [f for k, f in enumerate(optional) if mask >> k & 1])) for mask in range(1 << len(optional))]

    def canonical(self, record: Column) -> Column:
        return self.made({field: F.try_variant_get(record, F.lit(f"$.{field}"), "string") for _, field, _ in self.turns})

    def of_text(self, record: Column) -> Column:
        """The same from the JSON text, of any length."""
        read = F.from_json(record, "struct<" + ",".join(f"`{field}`:string" for _, field, _ in self.turns) + ">", ANY_LENGTH)
        return self.made({field: read[field] for _, field, _ in self.turns})

    def made(self, values: dict[str, Column]) -> Column:
        made = [
            F.when(F.lit(required) | values[field].isNotNull(), F.struct(F.lit(role).alias("role"), F.coalesce(values[field], F.lit("")).alias("text")))
            for role, field, required in self.turns
        ]
        return F.filter(F.array(*made), lambda t: t.isNotNull())


@dataclass(frozen=True)
class Messages:
    """A layout with an array of turns; ``roles`` renames its role values."""

    field: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[tuple[str, ...]]:
        base = (self.field,)
        return [tuple(sorted(base + more)) for more in ((), (f"{self.field}[].{self.role}",), (f"{self.field}[].{self.text}",), (f"{self.field}[].{self.role}", f"{self.field}[].{self.text}"))]

    def canonical(self, record: Column) -> Column:
        return self.made(F.try_variant_get(record, F.lit(f"$.{self.field}"), f"array<struct<{self.role}:string,{self.text}:string>>"))

    def of_text(self, record: Column) -> Column:
        """The same from the JSON text, of any length."""
        return self.made(F.from_json(record, f"struct<`{self.field}`:array<struct<`{self.role}`:string,`{self.text}`:string>>>", ANY_LENGTH)[self.field])

    def made(self, found: Column) -> Column:
        renamed = lambda r: F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in self.roles], r, F.lit(""))
        return F.transform(found, lambda m: F.struct(renamed(m[self.role]).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text")))


LAYOUTS = (
    Fields((("system", "system", False), ("user", "prompt", True), ("assistant", "response", True))),
    Fields((("system", "instruction", True), ("user", "input", True), ("assistant", "output", True))),
    Messages("messages", "role", "content"),
    Messages("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
)


def field_paths(schema: Column) -> Column:
    """Sorted paths of a record, from its variant schema: each name with those it is nested in, ``[]`` for arrays.

    The schema text is cut at its brackets and commas and folded once with a stack of open names, so the cost is linear in
    the schema and the stack as deep as the record.  Types and fields that are null do not count.
    """
    tokens = F.regexp_extract_all(schema, F.lit(r"`(?:[^`]|``)*`: |[A-Za-z_0-9]+: |OBJECT<|ARRAY<|>|, |[A-Z]+(?:\([0-9,]+\))?"), F.lit(0))
    state = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("found"), F.lit("").alias("name"))

    def step(s: Column, token: Column) -> Column:
        top = F.coalesce(F.element_at(F.when(F.size(s["open"]) > 0, s["open"]), -1), F.lit(""))
        full = F.concat(top, F.when(top == "", "").otherwise("."), F.regexp_replace(token, "`|: $", ""))
        opened = F.when(token == "ARRAY<", F.concat(F.when(s["name"] == "", top).otherwise(s["name"]), F.lit("[]"))).otherwise(F.when(s["name"] == "", top).otherwise(s["name"]))
        is_name, is_open = token.endswith(": "), token.isin("OBJECT<", "ARRAY<")
        # A path counts once a value that is not null stands behind it.
        counts = (s["name"] != "") & ~is_name & ~token.isin(", ", ">", "VOID")
        return F.struct(
            F.when(is_open, F.concat(s["open"], F.array(opened))).when(token == ">", F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            F.when(counts, F.concat(s["found"], F.array(s["name"]))).otherwise(s["found"]).alias("found"),
            F.when(is_name, full).otherwise("").alias("name"),
        )

    return F.aggregate(tokens, state, step, lambda s: F.array_sort(F.array_distinct(s["found"])))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Fields | Messages, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout_print`` (fingerprint) and ``turns`` (array of role, text) to records of JSON text; other columns pass through,
    whatever their names, but for those two, which are replaced.

    A null or broken record, and one of no known layout, has null turns, so the caller can count or route it; an empty array of
    messages gives no turns.  Null texts and roles inside a turn become empty.  A record too long for a variant is read from its
    text; its layout shows once long runs without quotes, backslashes and brackets, which stand inside strings, are cut out.
    One whose layout cannot be read even so is an error.
    """
    flat, text = numbered(records), F.col(at_place(records, record_col))
    parsed = flat.withColumn("v", F.try_parse_json(text)).withColumn("long", F.col("v").isNull() & (F.length(text) > LONG))
    bare = F.try_parse_json(F.regexp_replace(text, r'[^"\\{}\[\]]{64,}+', ""))
    parsed = parsed.withColumn("shape", F.when(F.col("long"), bare).otherwise(F.col("v"))).withColumn("layout_print", fingerprint(field_paths(F.schema_of_variant("shape"))))
    turns = F.when(F.col("long") & F.col("shape").isNull() & F.from_json(text, "map<string,string>", ANY_LENGTH).isNotNull(), F.raise_error(F.lit("the layout of a record is too long to read")).cast(TURNS))
    for layout in layouts:
        known = [fingerprint(F.array(*map(F.lit, p))) for p in layout.paths()]
        turns = F.when(F.col("layout_print").isin(*known), F.when(F.col("long"), layout.of_text(text)).otherwise(layout.canonical(F.col("v")))).otherwise(turns)
    done = parsed.withColumn("turns", F.when(F.col("v").isNotNull() | F.col("long"), turns))
    return named(done, records, {"layout_print": "layout_print", "turns": "turns"})


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column, learn: str = "assistant") -> dict[str, Column]:
    """The marked-up text, and the spans (start, length in code points, from 0) under the loss mask."""
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((start + F.length(p["body"]) + len(END)).alias("at"), F.when(p["learn"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return {"formatted": text, "loss_spans": F.aggregate(parts, empty, step, lambda s: s["spans"])}


def read_back(text: Column) -> Column:
    """Turns of a marked-up text: the inverse of ``formatted``."""
    pieces = F.filter(F.split(text, r"<\|done\|>"), lambda p: p.startswith(START))
    halves = F.transform(pieces, lambda p: F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"<\|text\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def under_mask(text: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def format_records(records: DataFrame, record_col: str = "record", layouts: tuple[Fields | Messages, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout_print, turns, formatted and loss_spans; null where the layout is unknown."""
    found = canonical_turns(records, record_col, layouts)
    return found.withColumns(formatted(F.col("turns")))


def records_from_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): rows by turn gathered into JSON records, each in the plainest layout that holds it.

    user-assistant (system before it or not) is written as prompt and response, all else as messages.  Turns are ordered by
    turn, then role and text, so ties and repeated rows have one order; null turns come first.  Null texts and roles are
    empty.  A conversation is one record and so must fit in one row, as any formatted conversation must.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("content")).alias("m"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    roles = F.array_join(F.transform("ms", lambda m: F.concat(F.length(m["role"]).cast("string"), F.lit(":"), m["role"])), ",")
    at = lambda k: F.get("ms", k)["content"]
    pair, triple = roles == "4:user,9:assistant", roles == "6:system,4:user,9:assistant"
    record = (
        F.when(pair, F.to_json(F.struct(at(F.lit(0)).alias("prompt"), at(F.lit(1)).alias("response"))))
        .when(triple, F.to_json(F.struct(at(F.lit(0)).alias("system"), at(F.lit(1)).alias("prompt"), at(F.lit(2)).alias("response"))))
        .otherwise(F.to_json(F.struct(F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))))
    )
    return gathered.select("conv_id", record.alias("record"))
