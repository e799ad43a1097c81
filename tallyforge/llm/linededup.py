"""Line dedup by content-defined chunks.

A rolling hash over the hashes of ``WINDOW`` lines ends a chunk where it is divisible by ``DIVISOR``, so that
boundaries follow the content and come back a few lines after an insertion. A line of ``LONG`` words or more is a
chunk of its own: a passage is then found whatever stands around it. Any two lines in a row with words are matched
too, so that a passage of several lines goes whole wherever chunks end. What of these occurs again anywhere in the corpus is removed, all but the first occurrence by doc_id and
place, after its text is compared byte for byte with that of the first.

Lines end at line feeds; words are told apart by spaces here. Null texts stay null and empty ones empty; a
document whose chunks all go stays with an empty text. Rows alike in id and text share one decision. ``n_chars``,
where there is such a column, is counted anew for texts that change. Other columns are kept.

Only hashes of chunks are shuffled at first; the text of repeated ones follows, and at last each document meets
its own list of removals. A chunk's first occurrence comes from an aggregation, never a window over its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import written

WINDOW, DIVISOR, LONG = 2, 3, 50
#: Copies of a chunk that are compared with the first one in one part.
HOT = 20_000


def _chunks(window: int, divisor: int, long: int) -> str:
    """SQL for the array of (text, n_lines, long) chunks of ``text``; null for a null text."""
    rolling = ", ".join("h[i]" if k == 0 else f"h[greatest(i - {k}, 0)]" for k in range(window))
    return f"""
    transform(array(split(text, '\n', -1)), l ->
      transform(array(struct(
          transform(l, x -> xxhash64(x)) as h,
          transform(l, x -> length(x) - length(replace(x, ' ', '')) >= {long - 1}) as big)), m ->
        transform(array(filter(sequence(0, size(l) - 1), i ->
            i = size(l) - 1 or m.big[i] or m.big[least(i + 1, size(l) - 1)]
            or pmod(xxhash64({rolling.replace("h[", "m.h[")}), {divisor}) = 0)), e ->
          transform(e, (to, k) -> struct(
            array_join(slice(l, if(k = 0, 0, e[greatest(k - 1, 0)] + 1) + 1, to - if(k = 0, -1, e[greatest(k - 1, 0)])), '\n') as text,
            size(filter(slice(l, if(k = 0, 0, e[greatest(k - 1, 0)] + 1) + 1, to - if(k = 0, -1, e[greatest(k - 1, 0)])), x -> trim(x) != '')) as n_lines,
            m.big[to] as big,
            if(k = 0, 0, e[greatest(k - 1, 0)] + 1) as from,
            to as to)))[0])[0])[0]
    """


def _units(window: int, divisor: int, long: int) -> str:
    """SQL for the array of (text, from, to) of all that is matched: long lines, chunks, and any two lines in a row.

    A chunk without blank lines is covered by its pairs of lines, so only others are listed.
    """
    chunks = f"transform(filter({_chunks(window, divisor, long)}, c -> c.big or (c.n_lines >= 2 and c.n_lines <= c.to - c.from)), c -> struct(c.text as text, c.from as from, c.to as to))"
    pairs = """
    transform(array(split(text, '\n', -1)), l ->
      transform(
        filter(sequence(0, greatest(size(l) - 2, 0)), i -> size(l) > 1 and trim(l[i]) != '' and trim(l[least(i + 1, size(l) - 1)]) != ''),
        i -> struct(concat(l[i], '\n', l[i + 1]) as text, i as from, i + 1 as to)))[0]
    """
    return f"concat({chunks}, {pairs})"


def removals(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, long: int = LONG) -> DataFrame:
    """doc_id, th (hash of the text) and gone (places of the lines to remove) of the documents that lose lines."""
    units = F.expr(f"transform({_units(window, divisor, long)}, c -> struct(xxhash64(c.text) as hash, c.from as at, c.to as upto))")
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(units).alias("c")).select("doc_id", "th", "c.hash", "c.at", "c.upto")
    place = F.struct("doc_id", "th", "at", "upto")
    again = each.select("hash", place.alias("place")).groupBy("hash").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    again = written(again.filter("n > 1").select("hash", "first", F.ceil(F.col("n") / F.lit(HOT)).cast("int").alias("parts")))
    # Hashes and places only so far; the text comes from the documents that hold what is repeated.
    repeated = each.join(again, "hash").select("doc_id", "th", F.struct("hash", "at", "upto", "parts", place.eqNullSafe(F.col("first")).alias("is_first")).alias("u"))
    of_doc = repeated.groupBy("doc_id", "th").agg(F.collect_list("u").alias("u")).withColumnsRenamed({"doc_id": "of_id", "th": "of_th"})
    lines = "transform(array(split(text, '\n', -1)), l -> transform(u, x -> struct(x as u, array_join(slice(l, x.at + 1, x.upto - x.at + 1), '\n') as chunk)))[0]"
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(of_doc, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")))
    held = written(held.select("doc_id", "th", F.explode(F.expr(lines)).alias("c")).select("doc_id", "th", "c.u.*", "c.chunk"))
    # A chunk with very many copies is dealt into parts, each with the first one's text.
    first = held.filter("is_first").groupBy("hash").agg(F.first("chunk").alias("first_chunk"), F.max("parts").alias("parts"))
    first = first.select("hash", "first_chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = held.filter("not is_first").withColumn("part", F.pmod(F.xxhash64("doc_id", "th", "at"), F.col("parts")).cast("int"))
    same = others.join(first, ["hash", "part"]).filter(F.col("chunk") == F.col("first_chunk"))
    return same.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", "upto")))).alias("gone"))


def dedup(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, long: int = LONG) -> DataFrame:
    """``docs`` without the repeated lines, and _removed: how many lines each row lost (a column of that name is replaced)."""
    gone = removals(docs, window, divisor, long).withColumnsRenamed({"doc_id": "gone_id", "th": "gone_th"})
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_th")), "left")
    rest = F.expr("array_join(filter(split(text, '\n', -1), (x, i) -> not array_contains(gone, i)), '\n')")
    changed = F.col("gone").isNotNull()
    joined = joined.withColumn("text", F.when(changed, rest).otherwise(F.col("text")))
    out = {c: F.col("row")[c] for c in docs.columns if c != "_removed"} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.select(*[c.alias(name) for name, c in out.items()], F.coalesce(F.size("gone"), F.lit(0)).alias("_removed"))


def dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (lines), n_chars (of what is left) and the text that is left."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_removed").cast("long").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
