"""Models' answers as they come: tolerant parsing, what is wrong with them, what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_thoughts

#: Keys under which models put the list of items.
WRAPPERS = ("captions", "results", "items", "data", "outputs")
ITEM = "map<string,array<string>>"


def whole(text: Column) -> Column:
    """The answer as a variant: the text itself, or what begins with its first bracket and ends with its last. Null if neither is JSON."""
    brace, square = F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    early = F.try_parse_json(F.when((F.instr(text, "[") > 0) & ((F.instr(text, "[") < F.instr(text, "{")) | (F.instr(text, "{") == 0)), square).otherwise(brace))
    return F.coalesce(F.try_parse_json(text), early)


def items_of(v: Column) -> Column:
    """The list of items as JSON texts: the answer itself, what stands under one of the WRAPPERS, or the values of an object whose keys
    are all numbers, in their order; null if there is no list."""
    ways = [F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in WRAPPERS)]
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    numbered = (F.size(entries) > 0) & F.forall(entries, lambda e: e["key"].rlike("^[0-9]{1,18}$"))
    by_number = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].try_cast("bigint").alias("k"), F.to_json(e["value"]).alias("v"))))
    return F.coalesce(F.transform(F.coalesce(*ways), lambda x: F.to_json(x)), F.when(numbered, by_number["v"]))


def _nested(depth: int) -> str:
    """A complete JSON object of at most so many levels; braces within strings don't count. The quantifiers don't go back, so long texts need no deep stack."""
    text = r'"(?:[^"\\]++|\\.)*+"'
    out = rf'\{{(?:[^{{}}"]++|{text})*+\}}'
    for _ in range(depth - 1):
        out = rf'\{{(?:[^{{}}"]++|{text}|{out})*+\}}'
    return out


def salvaged(text: Column) -> Column:
    """The complete objects, of up to four levels, that a list begins with before it breaks off; what isn't an object is left out."""
    inner = F.regexp_replace(text, r'(?s)^[^\[{]*+\{\s*"\w+"\s*:\s*\[', "[")
    skipped = r'[\s\[,]*+(?:(?:"(?:[^"\\]++|\\.)*+"|[^\s\[\],{}"]++)[\s,]*+)*+'
    return F.regexp_extract_all(inner, F.lit(rf"(?s)\G{skipped}({_nested(4)})"), F.lit(1))


def parsed(answers: DataFrame) -> DataFrame:
    """answers: (id, text, n_expected). Adds items (texts of JSON objects) and status: 'ok', 'loop' (more items than asked for; the first are kept), 'short', 'salvaged' (the list
    breaks off), 'shape' (JSON without a list of objects), 'unparseable'; n_items, and n_nontrivial, the items that say anything."""
    text = without_thoughts(F.coalesce("text", F.lit("")))
    v = answers.withColumn("__text", text).withColumn("__v", whole(F.col("__text")))
    objects = F.filter(items_of(F.col("__v")), lambda x: F.startswith(x, F.lit("{")))
    rows = v.withColumns({"__list": items_of(F.col("__v")), "__objects": objects, "__saved": salvaged(F.col("__text"))})
    broken = F.col("__v").isNull()
    found = F.when(broken, F.col("__saved")).otherwise(F.col("__objects"))
    n, want = F.size(F.coalesce(found, F.array().cast("array<string>"))), F.col("n_expected")
    status = (
        F.when(broken & (n > 0), "salvaged").when(broken, "unparseable").when(F.col("__list").isNull() | (n == 0) & (F.size("__list") > 0), "shape").when(n > want, "loop").when(n < want, "short").otherwise("ok")
    )
    items = F.slice(F.coalesce(found, F.array().cast("array<string>")), F.lit(1), F.greatest(want, F.lit(0)))
    said = F.size(F.filter(items, lambda x: x.rlike(r"\[\s*[^\]\s]")))
    return rows.select(*answers.columns, items.alias("items"), status.alias("status"), n.cast("long").alias("n_items"), said.cast("long").alias("n_nontrivial"))


def retry_action(status: Column, finish: Column, n_nontrivial: Column, longest_missing: Column) -> Column:
    """What to do: nothing about a good answer or one of the wrong shape; all again where nothing was said or the answer can't be read; the rest of one that breaks off or is short; and of a rest that
    is empty and whose texts say something, once more with a reminder."""
    return (
        F.when(status.isin("ok", "loop"), F.when((n_nontrivial == 0) & (longest_missing >= 15), "remind").otherwise("accept"))
        .when(status == "shape", "give_up")
        .when((status == "short") & (finish == "stop") & (n_nontrivial == 0), "redo_all")
        .when(status.isin("short", "salvaged"), "redo_tail")
        .otherwise("redo_all")
    )


def category_values(answered: DataFrame, key: str) -> DataFrame:
    """(key, place, category, value): the items of parsed answers. A value that isn't a list counts as a list of it; null as none."""
    rows = answered.select(key, F.posexplode("items").alias("place", "item"))
    pairs = rows.select(key, "place", F.explode(F.from_json("item", "map<string,string>")).alias("category", "raw"))
    values = F.coalesce(F.from_json("raw", "array<string>"), F.when(F.col("raw").isNotNull() & ~F.startswith("raw", F.lit("{")), F.array("raw")))
    return pairs.select(key, "place", "category", F.explode(values).alias("value")).where("value is not null")


def repaired(items: Column, n: Column, fallback: Column) -> Column:
    """A list of exactly n items: what is too much goes, what lacks is the fallback. A null list has none."""
    own = F.slice(F.coalesce(items, F.array().cast("array<string>")), F.lit(1), F.greatest(n, F.lit(0)))
    return F.concat(own, F.array_repeat(fallback, F.greatest(n - F.size(own), F.lit(0))))


def message_text(content: Column, reasoning: Column) -> Column:
    """What a model says: its content, or where that is blank what it reasons."""
    return F.when(F.coalesce(F.trim(content), F.lit("")) != "", content).otherwise(F.coalesce(reasoning, F.lit("")))
