"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, which a template renders.

DataFrame operations only. Records are JSON objects of unlike layouts. A record's nested field paths, sorted and hashed,
are its fingerprint; a fingerprint has one mapping; a mapping says where turns, roles and texts are.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of one conversation that are joined before its parts are.
PART_TURNS = 256


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns.

    items: path of the list of turns, with role and text paths inside an item; or, without items, `flat`: (role, path)
    of each turn in order. required and optional are the field paths by which a record is known ([] marks a list).
    roles renames roles, such as human to user.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str = ""
    role: str = "role"
    text: str = "content"
    flat: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> list[list[str]]:
        """Every set of paths that a record of this layout may have."""
        some = itertools.chain.from_iterable(
            itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1)
        )
        return [sorted({*self.required, *extra}) for extra in some]


MAPPINGS = (
    Mapping("turn", ("role", "text"), flat=(("@role", "text"),)),
    Mapping("messages", ("messages[].content", "messages[].role"), ("id", "source", "messages[].name"), items="messages"),
    Mapping(
        "conversations", ("conversations[].from", "conversations[].value"), ("id", "source"),
        items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"},
    ),
    Mapping("prompt_completion", ("completion", "prompt"), ("system",), flat=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), flat=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", ("answer", "question"), ("context",), flat=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
)


# --- Fingerprints --------------------------------------------------------------------------------------------------


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a variant: a.b for a field of an object, a[] for what is in a list; leaves only."""
    schema = F.schema_of_variant(record)
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`: |[^<>,` ]+: |OBJECT<|ARRAY<|>|,|[A-Z_]+(?:\([0-9, ]*\))?)"), F.lit(1))
    # The open path, the stack of closed-over prefixes (one string a level), and the leaves.
    state = F.struct(F.lit("").alias("at"), F.array(F.lit("")).alias("stack"), F.array().cast("array<string>").alias("leaves"))
    top = lambda s: F.element_at(s["stack"], -1)

    def make(at: Column, stack: Column, leaves: Column) -> Column:
        return F.struct(at.alias("at"), stack.alias("stack"), leaves.alias("leaves"))

    def step(s: Column, t: Column) -> Column:
        name = F.replace(F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - 2), "^`|`$", ""), F.lit("``"), F.lit("`"))
        prefix = F.when(top(s) == "", F.lit("")).otherwise(F.concat(top(s), F.lit(".")))
        pop = F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(1)))
        leaf = F.when(s["at"] == "", s["leaves"]).otherwise(F.array_union(s["leaves"], F.array(s["at"])))
        return (
            F.when(t.endswith(": "), make(F.concat(prefix, name), s["stack"], s["leaves"]))
            .when(t == "OBJECT<", make(s["at"], F.concat(s["stack"], F.array(s["at"])), s["leaves"]))
            .when(t == "ARRAY<", make(F.concat(s["at"], F.lit("[]")), F.concat(s["stack"], F.array(top(s))), s["leaves"]))
            .when(t == ">", make(F.lit(""), pop, s["leaves"]))
            .when(t == ",", make(F.lit(""), s["stack"], s["leaves"]))
            .otherwise(make(s["at"], s["stack"], leaf))
        )

    return F.array_sort(F.aggregate(tokens, state, step, lambda s: s["leaves"]))


def fingerprint(paths: Column) -> Column:
    """Hash of sorted field paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def _mapping_name(print_: Column, mappings: tuple[Mapping, ...]) -> Column:
    """Name of the mapping whose layouts have this fingerprint; null if none."""
    out = F.lit(None).cast("string")
    for m in reversed(mappings):
        known = [F.xxhash64(F.lit("\n".join(p))) for p in m.path_sets()]
        out = F.when(F.array_contains(F.array(*known), print_), F.lit(m.name)).otherwise(out)
    return out


# --- Canonical turns -----------------------------------------------------------------------------------------------


def _turns(v: Column, m: Mapping) -> Column:
    """array<struct<role, text>> of a record by a mapping. Optional turns without text are left out."""
    get = lambda at, kind: F.try_variant_get(v, "$." + at, kind)
    if m.items:
        raw = F.try_variant_get(v, f"$.{m.items}", f"array<struct<`{m.role}`: string, `{m.text}`: string>>")
        turns = F.transform(raw, lambda x: F.struct(_renamed(x[m.role], m.roles).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))
        return turns
    needed = {p.split("[]")[0] for p in m.required}
    each = []
    for role, path in m.flat:
        who = get(role[1:], "string") if role[0] == "@" else F.lit(role)
        turn = F.struct(_renamed(who, m.roles).alias("role"), F.coalesce(get(path, "string"), F.lit("")).alias("text"))
        each.append(turn if path in needed else F.when(F.coalesce(get(path, "string"), F.lit("")) != "", turn))
    return F.array_compact(F.array(*each))


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in roles.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def canonical_turns(records: DataFrame, keys: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """keys, pos, role, text, mapping, fingerprint: one row for each turn of each record (column `record`, JSON text).

    Records whose fingerprint no mapping has, and those that are not JSON objects, give one row with null pos and
    mapping, so that nothing is lost unseen; mapped() makes an error of them. A record of more than 128 MB cannot be parsed and is one of them. Null
    texts are empty; null roles are empty. Repeated records give their turns as often. An empty table gives no rows; columns of records
    other than keys and `record` are ignored, and keys keep their names.
    """
    v = F.try_parse_json("record")
    known = records.select(*keys, v.alias("_v")).withColumn("fingerprint", fingerprint(field_paths(F.col("_v"))))
    named = known.withColumn("mapping", _mapping_name(F.col("fingerprint"), mappings))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in reversed(mappings):
        turns = F.when(F.col("mapping") == m.name, _turns(F.col("_v"), m)).otherwise(turns)
    return named.withColumn("_turns", turns).select(
        *keys, F.posexplode_outer("_turns").alias("pos", "_turn"), "mapping", "fingerprint"
    ).select(*keys, "pos", "_turn.role", "_turn.text", "mapping", "fingerprint")


def mapped(turns: DataFrame) -> DataFrame:
    """Turns of canonical_turns(), all of which must have a mapping: a record without one fails the job instead of going."""
    odd = F.raise_error(F.concat(F.lit("no mapping for a record of fingerprint "), F.coalesce(F.col("fingerprint").cast("string"), F.lit("null"))))
    return turns.where(F.when(F.col("mapping").isNotNull() & F.col("pos").isNotNull(), F.lit(True)).otherwise(odd.cast("boolean")))


# --- Template ------------------------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    r"""Make control strings harmless: `<|` becomes `<\|`, and a run of backslashes between < and | grows by one."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    r"""A role on one line: as a text, with \n for a line end and \\ for a backslash."""
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(line)


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")  # doubled backslashes; what stands between them has line ends only
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(role: Column, text: Column) -> Column:
    """One turn between its marks."""
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def format_conversations(turns: DataFrame, key: str, order: list[str], loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """key, formatted, mask (array<struct<head, text, tail, loss>>): conversations in their order of turns.

    turns: key, role, text and the order columns. The mask has for each turn the code points before its text, of its
    escaped text and behind it, and whether the text counts for the loss. Turns are first joined in parts of PART_TURNS,
    then parts, so that a conversation of very many turns meets in one place as a few long strings only. Ties in the order
    are broken by role and text, so repeated rows stay next to each other; rows with a null key are one conversation. Texts of
    any length that a string may have are taken whole. Further columns are ignored, whatever their names; an empty table gives no rows.
    """
    clean = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    head, tail = F.length(escape_role(F.col("role"))) + len(START) + 1, F.lit(len(END) + 1)
    run = F.struct(
        head.alias("head"), F.length(escape(F.col("text"))).alias("text"), tail.alias("tail"), F.col("role").isin(*loss_roles).alias("loss")
    )
    row = F.struct(*order, "role", "text", render(F.col("role"), F.col("text")).alias("shown"), run.alias("run"))
    part = F.floor(F.col(order[0]) / PART_TURNS).alias("_part")
    parts = clean.groupBy(key, part).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    piece = F.struct("_part", F.array_join("_rows.shown", "").alias("shown"), F.col("_rows.run").alias("runs"))
    whole = parts.select(key, piece.alias("_piece")).groupBy(key).agg(F.array_sort(F.collect_list("_piece")).alias("_parts"))
    return whole.select(key, F.array_join("_parts.shown", "").alias("formatted"), F.flatten("_parts.runs").alias("mask"))


def read_back(formatted: Column, mask: Column) -> Column:
    """array<struct<role, text, loss>> of a formatted conversation.

    Roles and texts come from the string alone: no escaped role or text holds a mark or, in a role, a line end, so cutting
    there is exact. The mask only says which texts count for the loss.
    """
    chunks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)

    def turn(c: Column, run: Column) -> Column:
        role = F.substring_index(c, "\n", 1)
        size = F.length(c) - F.length(role) - (len(END) + 2)
        text = unescape(F.substring(c, F.length(role) + 2, size))
        return F.struct(unescape_role(role).alias("role"), text.alias("text"), run["loss"].alias("loss"))

    return F.zip_with(chunks, mask, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """array<string>: the texts that count for the loss, unescaped, cut out by the mask's code points alone.

    A turn begins where the turns before it, by their masked sizes, end. A mask that does not cover the string exactly, turn for
    turn, fails the job.
    """
    chunks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)
    fits = F.zip_with(chunks, mask, lambda c, run: F.coalesce(F.length(c) + len(START) == run["head"] + run["text"] + run["tail"], F.lit(False)))
    texts = F.zip_with(chunks, mask, lambda c, run: F.when(run["loss"], unescape(F.substring(c, run["head"] - len(START) + 1, run["text"]))))
    return F.when(F.forall(fits, lambda x: x), F.array_compact(texts)).otherwise(F.raise_error(F.lit("the mask does not fit its conversation")).cast("array<string>"))
