"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records arrive as JSON in unlike layouts. The nested field paths of a record, without the types
of its scalars, are hashed; the hash selects a declared mapping that turns the record into
canonical turns. Turns become text in a marked template from which they can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: fixed values.
START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<pos: bigint, role: string, text: string>"


@dataclass(frozen=True)
class Layout:
    """A declared mapping.

    required, optional: field paths, `a.b` for objects and `a[].b` for arrays of objects.
    turns: (role, path) pairs for records with a field per turn; a role in braces names a path.
    list_path, role_path, text_path: for records with an array of messages.
    key_path, pos_path: for records that are one turn of a longer conversation.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    list_path: str | None = None
    role_path: str | None = None
    text_path: str | None = None
    pos_path: str | None = None


#: Roles as layouts write them, and the canonical ones: fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

LAYOUTS = (
    Layout("row", ("role", "text", "turn"), turns=(("{role}", "text"),), pos_path="turn"),
    Layout("prompt", ("completion", "prompt"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("messages", ("messages[].content", "messages[].role"), list_path="messages", role_path="role", text_path="content"),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), list_path="conversations", role_path="from", text_path="value"),
)


def _tree(paths: tuple[str, ...]) -> dict:
    root: dict = {}
    for path in paths:
        at = root
        for part in path.split("."):
            at = at.setdefault(part, {})
    return root


def _signature(tree: dict) -> str:
    """The text that `path_signature` makes of a record with these paths."""
    parts = []
    for name in sorted(tree, key=lambda x: x.removesuffix("[]")):
        inner = _signature(tree[name]) if tree[name] else ""
        if name.endswith("[]"):
            inner = f"ARRAY<{inner}>"
        parts.append(f"{name.removesuffix('[]')}: {inner}" if inner else name.removesuffix("[]"))
    return f"OBJECT<{', '.join(parts)}>"


def path_signature(record: Column) -> Column:
    """The nested field paths of a VARIANT, in one canonical text; types of scalars are left out."""
    scalar = r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\s?\d+\))?"
    return F.regexp_replace(F.schema_of_variant(record), scalar, "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(path_signature(record))


def _selected(sig: Column, layouts: tuple[Layout, ...]) -> Column:
    """The name of the layout whose fingerprint equals the record's; null if none."""
    name = F.lit(None).cast("string")
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for more in combinations(layout.optional, n):
                known = F.xxhash64(F.lit(_signature(_tree((*layout.required, *more)))))
                name = F.when(sig == known, layout.name).otherwise(name)
    return name


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, role), role)


def _turns(layout: Layout, record: Column) -> Column:
    """Canonical turns of a record in this layout."""
    if layout.list_path:
        kind = f"array<struct<`{layout.role_path}`: string, `{layout.text_path}`: string>>"
        items = F.try_variant_get(record, f"$.{layout.list_path}", kind)
        return F.transform(items, lambda x, i: F.struct(i.cast("bigint").alias("pos"), _role(x[layout.role_path]).alias("role"), F.coalesce(x[layout.text_path], F.lit("")).alias("text")))
    made = []
    for i, (role, path) in enumerate(layout.turns):
        parts = [_text(record, p) for p in path.split("+")]
        text = parts[0] if len(parts) == 1 else F.concat_ws("\n", *[F.when(p != "", p) for p in parts])
        pos = F.try_variant_get(record, f"$.{layout.pos_path}", "bigint") if layout.pos_path else F.lit(i).cast("bigint")
        turn = F.struct(pos.alias("pos"), (_role(_text(record, role[1:-1])) if role[0] == "{" else F.lit(role)).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        # A field that a layout may lack makes no turn.
        made.append(F.when(parts[0].isNotNull(), turn) if path in layout.optional else turn)
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def escape(text: Column) -> Column:
    """No mark can come from a text: `<`, any backslashes and `|` get one more backslash."""
    return F.when(text.contains("<"), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(text.contains("<\\"), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")).otherwise(text)


def canonical_turns(records: DataFrame, key: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """A row per turn: key, layout, fingerprint, pos, role, text.

    record is a JSON text. A record with paths that no layout declares, and one that is no
    JSON, gives one row with null layout, pos, role and text: it is reported, not dropped. Null
    texts are empty, null roles are the empty role.
    """
    one = records.select(F.col(key).alias("_key"), F.try_parse_json(F.col(record)).alias("_v"))
    one = one.withColumn("_print", fingerprint(F.col("_v")))
    one = one.withColumn("_layout", _selected(F.col("_print"), layouts))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for x in layouts:
        turns = F.when(F.col("_layout") == x.name, _turns(x, F.col("_v")).cast(f"array<{TURN}>")).otherwise(turns)
    out = one.select("_key", "_layout", "_print", F.explode_outer(turns).alias("t"))
    return out.select(F.col("_key").alias(key), F.col("_layout").alias("layout"), F.col("_print").alias("fingerprint"), "t.pos", "t.role", "t.text")


def format_chats(records: DataFrame, key: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: key, n_turns, formatted, loss_mask.

    formatted joins `START role newline text END newline` over the turns in order; roles are
    percent-encoded and marks within texts escaped, so that `read_turns` restores them. Turns
    order by position, then role and text (ties and repeated rows keep all turns). loss_mask has
    (start, length) of the text to learn from in each turn, in code points from the start of that
    turn in `formatted`; other turns have length 0. Each turn is formatted before conversations are gathered, so a
    task holds no more than the conversations it returns. Conversations of unknown layout come with n_turns 0.
    """
    turns = canonical_turns(records, key, record, layouts)
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    made = F.when(F.col("role").isNotNull(), F.struct(
        F.col("pos"),
        F.col("role"),
        F.concat(head, body, F.lit(END), F.lit("\n")).alias("segment"),
        F.length(head).alias("start"),
        F.length(body).alias("length"),
    ))
    grouped = turns.select(F.col(key), made.alias("m")).groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("m"))
    mask = F.transform("m", lambda x: F.struct(x["start"].alias("start"), F.when(x["role"].isin(*learn), x["length"]).otherwise(0).alias("length")))
    return grouped.select(key, F.size("m").cast("bigint").alias("n_turns"), F.array_join("m.segment", "").alias("formatted"), mask.alias("loss_mask"))


def segments(formatted: Column) -> Column:
    """The turns of a formatted text, still escaped and without their end mark."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """Turns as array<struct<role, text>>, read back from a formatted text."""
    skip = len(START)

    def one(x: Column) -> Column:
        at = F.locate("\n", x)
        return F.struct(
            F.url_decode(F.substring(x, F.lit(skip + 1), at - F.lit(skip + 1))).alias("role"),
            unescape(F.substring(x, at + 1, F.length(x))).alias("text"),
        )

    return F.transform(segments(formatted), one)


def loss_texts(formatted: Column, mask: Column) -> Column:
    """What lies under the loss mask, unescaped, in order; empty for turns without loss."""
    return F.zip_with(segments(formatted), mask, lambda x, m: unescape(F.substring(x, m["start"] + 1, m["length"])))
