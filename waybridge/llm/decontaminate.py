"""Benchmark items inside documents, also with other numbers, names or units.

Texts become templates: a token with a digit is ``<num>``, a capitalised word inside a
sentence ``<name>``, a unit of measure ``<unit>``; other tokens lose outer punctuation, and
A-Z their case.  Windows of the templates are joined by hash.  Along one alignment of document
and item the values behind the placeholders must map one to one, so that a question with
changed figures is found and a chance meeting of placeholders is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import copied_if_small, lower_ascii, once, or_empty, read
from waybridge.session import materialized

#: tokens of a window
WINDOW = 8
#: share of an item's windows that a document must hold
COVER = 0.5
#: rows of the side that is copied to all executors; a larger one is shuffled
COPIED_ROWS = 200_000
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents mph kph degrees celsius fahrenheit watt watts volt volts"
).split()
_MARKS = r"[!-/:;=?@\[-`{-~]+"
_SPACE = r"[\t-\r ]+"


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t-\r ]{2,}|[\t-\r]", " ")


def template(flat: Column) -> Column:
    """The template of a text whose white space is single blanks, but for units; tokens stay in place."""
    out = F.regexp_replace(flat, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<num>")
    out = F.regexp_replace(out, r"(?<=[^ .!?:] )(?=\p{Lu}\p{Ll})[^ ]+", "<name>")
    out = lower_ascii(out)
    # the first lookahead only spares the costlier looks around at most places
    return F.regexp_replace(
        out,
        rf"(?={_MARKS[:-1]})(?:(?<=[\p{{L}}\p{{N}}>]){_MARKS}(?= |$)|(?<![^ ]){_MARKS}(?=[\p{{L}}\p{{N}}<]))",
        "",
    )


def _tokens(flat: Column) -> Column:
    return F.split(flat, " ", -1)


def _template_tokens(flat: Column) -> Column:
    return F.transform(
        _tokens(template(flat)), lambda t: F.when(t.isin(UNITS), "<unit>").otherwise(t)
    )


def _windows(tokens: Column, size: int) -> Column:
    """Array of (position from 1, hash) of all runs of ``size`` tokens; none if shorter."""
    last = F.size(tokens) - size + 1
    at = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(tokens, i, size)).alias("h")))


def _literal(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin("<num>", "<name>", "<unit>", ""))


def item_windows(bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, len, b, h): windows of the items in which at least half the tokens are words."""
    flat = spaced(or_empty(F.col("text")))
    items = once(bench, c=_template_tokens(flat), r=_tokens(flat)).withColumnRenamed("item_id", "item")
    spread = items.select("item", "c", "r", F.explode_outer(_windows(F.col("c"), size)).alias("w"))
    return spread.filter(
        F.size(_literal(F.slice("c", F.col("w.i"), size))) * 2 >= size
    ).select("item", "c", "r", F.col("w.i").alias("b"), F.col("w.h").alias("h"))


def contaminated(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    cover: float = COVER,
    copied_rows: int = COPIED_ROWS,
) -> DataFrame:
    """(id, item, windows, item_windows, changed): items that documents hold.

    ``windows`` of the item's ``item_windows`` stand in the document, on alignments whose
    placeholder values map one to one; ``changed`` is true if values differ.  An item
    counts from a share of ``cover`` on.  Items without a full window of mostly words
    give no evidence and are passed over, as are null and empty texts.  Repeated rows come
    out once; rows with one id and different texts are judged apart, and either one's rows
    are returned.  A document enters whole; only its windows that some item has leave
    the scan.
    """
    items = materialized(item_windows(bench, size), "items")
    totals = items.groupBy("item").agg(F.countDistinct("b").alias("item_windows"))
    keys = materialized(items.select("h").distinct(), "keys")
    places = items.select("item", "b", "h").distinct()
    text = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")
    ).filter(F.col("text").isNotNull())
    tokens = once(text, c=_template_tokens(spaced(F.col("text")))).select("id", "th", "c")
    spread = tokens.select("id", "th", F.explode_outer(_windows(F.col("c"), size)).alias("w")).select(
        "id", "th", F.col("w.i").alias("i"), F.col("w.h").alias("h")
    )
    found = spread.join(copied_if_small(keys, copied_rows), "h", "left_semi")
    # a window that many items share meets them all; hits per document and item are summed first
    hits = found.join(places, "h").groupBy("id", "th", "item", (F.col("i") - F.col("b")).alias("d")).agg(
        F.collect_set("b").alias("bs")
    )
    hits = materialized(hits, "hits")
    enough = F.col("n") >= cover * F.col("item_windows")
    whole = (
        hits.groupBy("id", "th", "item")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("bs")))).alias("n"))
        .join(totals, "item")
        .filter(enough)
    )
    same = [
        hits["id"].eqNullSafe(whole["id"]), hits["th"] == whole["th"], hits["item"].eqNullSafe(whole["item"]),
    ]
    close = materialized(
        hits.join(whole, same, "left_semi").select("id", "th", "item", "d", "bs"), "close"
    )
    wanted = copied_if_small(close, copied_rows).withColumnRenamed("id", "hit_id")
    texts = text.join(
        wanted, text["id"].eqNullSafe(wanted["hit_id"]) & (text["th"] == wanted["th"])
    ).select("id", text["th"], "item", "d", "bs", "text")
    flat = spaced(F.col("text"))
    both = once(texts, doc_r=_tokens(flat), doc_c=_template_tokens(flat)).drop("text")
    own = items.select("item", "c", "r").distinct().withColumnRenamed("item", "own_item")
    aligned = both.join(own, both["item"].eqNullSafe(own["own_item"]))
    # item positions under the windows that stand in the document
    covered = F.array_distinct(
        F.flatten(F.transform("bs", lambda b: F.sequence(b, b + F.lit(size - 1))))
    )

    def differs(p: Column) -> Column:
        return F.get("c", p - 1) != F.get("doc_c", p - 1 + F.col("d").cast("int"))

    def slot(p: Column) -> Column:
        bare = lambda t: F.regexp_replace(t, rf"{_MARKS}$", "")
        return F.struct(
            F.get("c", p - 1).alias("kind"),
            bare(F.get("r", p - 1)).alias("was"),
            bare(F.get("doc_r", p - 1 + F.col("d").cast("int"))).alias("now"),
        )

    slots = F.transform(
        F.filter("at", lambda p: F.get("c", p - 1).isin("<num>", "<name>", "<unit>")), slot
    )
    checked = (
        once(aligned, at=covered)
        .filter(F.size(F.filter("at", differs)) == 0)
        .transform(once, slots=F.array_distinct(slots))
        .filter(
            (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["was"]))))
            & (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["now"]))))
        )
    )
    return (
        checked.groupBy("id", "th", "item")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("bs")))).alias("n"),
            F.max(F.exists("slots", lambda s: s["was"] != s["now"])).alias("changed"),
        )
        .join(totals, "item")
        .filter(enough)
        .select("id", "item", F.col("n").alias("windows"), F.col("item_windows").cast("int"), "changed")
        .distinct()
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item; columns stay as they are.

    Rows with a null id that hold an item go with all rows of the same text.
    """
    marked = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    gone = contaminated(marked, bench, id_col="_key").select(F.col("id").alias("_gone")).distinct()
    return marked.join(gone, marked["_key"] == gone["_gone"], "left_anti").drop("_key")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows", "changed"
    )


QUERIES = {"op8_decontaminate": op8_decontaminate}

_CANON = (
    "list_transform(r, lambda x, i: case when regexp_matches(x, '[0-9]') then '<num>' "
    r"when i > 1 and r[i-1] <> '' and not regexp_matches(r[i-1], '[.!?:]$') and regexp_matches(x, '^\p{Lu}\p{Ll}') then '<name>' "
    f"else regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([\\p{{L}}\\p{{N}}>]){_MARKS}$', '\\1'), '^{_MARKS}([\\p{{L}}\\p{{N}}<])', '\\1') end)"
)
_SIDE = f"""
select k, r, list_transform(c, lambda x: case when regexp_matches(x, '^(?:{'|'.join(UNITS)})$') then '<unit>' else x end) as c
from (select k, r, {_CANON} as c
      from (select k, string_split(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') as r from (FROMTABLE) where text is not null))
"""
SQL = {
    "op8_decontaminate": f"""
with docs as ({_SIDE.replace('FROMTABLE', 'select doc_id as k, text from documents')}),
items as ({_SIDE.replace('FROMTABLE', 'select item_id as k, text from benchmark')}),
dw as (select k, i, array_to_string(c[i:i+{WINDOW - 1}], ' ') as w from docs, unnest(range(1, len(c) - {WINDOW - 2})) as u(i)),
bw as (select k, i, w from (
  select k, i, array_to_string(c[i:i+{WINDOW - 1}], ' ') as w,
         len(list_filter(c[i:i+{WINDOW - 1}], lambda x: x not in ('<num>', '<name>', '<unit>', ''))) as words
  from items, unnest(range(1, len(c) - {WINDOW - 2})) as u(i)) where words * 2 >= {WINDOW}),
total as (select k, count(distinct i) as item_windows from bw group by k),
hits as (select distinct dw.k as doc, bw.k as item, dw.i - bw.i as d, bw.i as b from dw join bw on dw.w = bw.w),
places as (select distinct doc, item, d, b + j as p from hits, unnest(range(0, {WINDOW})) as u(j)),
slots as (
  select distinct p.doc, p.item, p.d, items.c[p.p] as kind,
         regexp_replace(items.r[p.p], '{_MARKS}$', '') as was,
         regexp_replace(docs.r[p.p + p.d], '{_MARKS}$', '') as now
  from places p join docs on docs.k = p.doc join items on items.k = p.item
  where items.c[p.p] in ('<num>', '<name>', '<unit>')),
judged as (
  select doc, item, d, count(*) = count(distinct was) and count(*) = count(distinct now) as good, bool_or(was <> now) as changed
  from slots group by doc, item, d)
select h.doc as doc_id, h.item as item_id, cast(count(distinct h.b) as integer) as windows,
       cast(any_value(t.item_windows) as integer) as item_windows, bool_or(coalesce(j.changed, false)) as changed
from hits h left join judged j on h.doc = j.doc and h.item = j.item and h.d = j.d
join total t on t.k = h.item
where coalesce(j.good, true)
group by h.doc, h.item having count(distinct h.b) >= {COVER} * any_value(t.item_windows)
"""
}
