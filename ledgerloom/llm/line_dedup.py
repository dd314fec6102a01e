"""Line deduplication by a log-template tree of fixed depth, in DataFrame functions only.

A line's words are masked where they hold digits or an at sign. The tree's first level is the
number of words, the next ones are the leading words; a leaf holds the templates that agree in
these. What comes after the leading words is cut into fields, of one word each in shorter lines.
A field that enough documents of the leaf share is constant, unless it alone tells two patterns
apart; any other is variable. A general template is the leaf and its constant fields, at least
half of all, and lines that recur word for word take part in it. Templates that recur in enough documents are dropped from all of them but the first.
Documents of equal text count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C

#: Documents of different text that a template must recur in: usually, where it is longer than a passage, where it is short.
LEAST_DOCS, LONG_DOCS, SHORT_DOCS = 3, 2, 10
#: Words from which a line isn't short, and beyond which it is a passage.
LEAST_WORDS, LONG_WORDS = 5, 50
#: Leading words that lead to a leaf; fields of a line, most of them; words from which a line may have variable fields.
LEAD_WORDS, FIELDS, VARIABLE_WORDS = 4, 6, 8
_FIELDS = [f"f{i}" for i in range(FIELDS)]


def _key(*parts: Column) -> Column:
    """128 bits of what the parts say."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts).cast("binary")))


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, n, template, leaf, f0, ...) of each line with words; leaf and fields are null in shorter ones."""
    lines = docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Most lines have nothing to mask, and a single blank is split without a regular expression.
    masked = F.when(F.col("line").rlike("[0-9@]"), F.regexp_replace("line", r"[^\s0-9@]*[0-9@]\S*", "<*>")).otherwise(F.col("line"))
    words = lines.select("doc_id", "text_key", "pos", F.filter(F.split(F.translate(masked, "\t\x0b\f\r", "    "), " "), lambda w: w != "").alias("w")).withColumn("n", F.size("w")).where("n > 0")
    rest, long = F.col("n") - LEAD_WORDS, F.col("n") >= VARIABLE_WORDS
    many = F.least(rest, F.lit(FIELDS))
    cut = lambda i: F.floor(rest * i / many).cast("int") + LEAD_WORDS
    fields = [F.when(long & (many > i), F.xxhash64(F.slice("w", cut(i) + 1, cut(i + 1) - cut(i)))).alias(name) for i, name in enumerate(_FIELDS)]
    leaf = F.when(long, F.xxhash64("n", F.slice("w", 1, LEAD_WORDS))).alias("leaf")
    return words.select("doc_id", "text_key", "pos", "n", _key(F.col("w")).alias("template"), leaf, *fields)


def _recurring(lines: DataFrame, key: str, need: Column, n: Column) -> DataFrame:
    """(key, first, texts): keys in enough documents, the text of the first of them, and how many texts hold them."""
    per_text = lines.groupBy(key, "text_key").agg(F.min("doc_id").alias("d"), F.max(n).alias("n"))
    found = per_text.groupBy(key).agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min_by("text_key", F.struct(F.col("d").isNull(), "d", "text_key")).alias("first"))
    return found.where(F.col("texts") >= need).select(key, "first", "texts")


def general_templates(lines: DataFrame, least_docs: int) -> DataFrame:
    """(template, general): the general template of lines in leaves that enough documents share; only general ones of several templates."""
    long = lines.where("leaf IS NOT NULL").select("leaf", "template", "text_key", *_FIELDS)
    short_key = F.xxhash64("template")
    leaves = long.groupBy("leaf").agg(F.count("*").alias("lines"), F.min(short_key).alias("a"), F.max(short_key).alias("b")).where(f"lines >= {least_docs} AND a <> b").select("leaf", "lines")
    held = C.hot_join(long, C.cut(leaves, per_core=1), "leaf", "lines", "text_key")
    t = C.cut(held.select("leaf", "template", "text_key", *_FIELDS).distinct().groupBy("leaf", "template", *_FIELDS).agg(F.count("*").alias("texts")), per_core=1)
    fields = t.select("template", "texts", F.posexplode(F.array(*_FIELDS)).alias("i", "field"), "leaf").where("field IS NOT NULL").withColumn("place", F.xxhash64("leaf", "i", "field"))
    constant = fields.groupBy("place").agg(F.sum("texts").alias("s"), F.count("*").alias("k")).where(F.col("s") >= least_docs).select("place", "k")
    marked = C.hot_join(fields, C.cut(constant, per_core=1), "place", "k", "template")
    parts = marked.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("i", "field"))).alias("held"))
    size = sum(F.col(f).isNotNull().cast("int") for f in _FIELDS)
    pattern = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.try_element_at("held", i))
    enough = lambda p: 2 * F.size(F.array_compact(p)) >= F.size(p)
    patterns = C.cut(t.join(parts, "template").select("template", "leaf", "texts", pattern.alias("p")).where(enough(F.col("p"))), per_core=1)
    # A field whose value alone tells two patterns apart is variable in both, however often each value comes.
    one = patterns.select("template", "leaf", "p", F.posexplode("p").alias("i", "value"))
    other = F.transform("p", lambda v, j: F.when(j == F.col("i"), F.lit(0)).otherwise(F.coalesce(v, F.lit(1))))
    one = one.select("template", "i", F.xxhash64("leaf", "i", other).alias("place"), F.coalesce("value", F.lit(0)).alias("value"))
    differ = one.groupBy("place").agg(F.count("*").alias("k"), F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b").select("place", "k")
    variable = C.hot_join(one, C.cut(differ, per_core=1), "place", "k", "template").groupBy("template").agg(F.collect_set("i").alias("v"))
    fewer = F.transform("p", lambda v, i: F.when(~F.array_contains("v", i), v))
    settled = F.when(F.col("v").isNotNull() & enough(fewer), fewer).otherwise(F.col("p"))
    said = F.transform(settled, lambda v: F.coalesce(v.cast("string"), F.lit("*")))
    general = patterns.join(variable, "template", "left").select("template", "texts", _key(F.col("leaf").cast("string"), said).alias("general"))
    general = C.cut(general, per_core=1)
    several = general.groupBy("general").agg(F.count("*").alias("k"), F.sum("texts").alias("s")).where(f"k > 1 AND s >= {least_docs}").select("general", "k")
    return C.hot_join(general, C.cut(several, per_core=1), "general", "k", "template").select("template", "general")


def dropped_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_key, pos) of the lines to drop; some may come twice."""
    need = F.when(F.col("n") > LONG_WORDS, min(LONG_DOCS, least_docs)).when(F.col("n") >= LEAST_WORDS, least_docs).otherwise(max(SHORT_DOCS, least_docs))
    whole = _recurring(lines, "template", need, F.col("n"))
    general = general_templates(lines, least_docs)
    either = C.cut(whole.join(general, "template", "full").withColumn("texts", F.coalesce("texts", F.lit(1))), per_core=1)
    held = C.cut(C.hot_join(lines.select("doc_id", "text_key", "pos", "n", "template"), either, "template", "texts", "text_key").select("doc_id", "text_key", "pos", "n", "first", "general"))
    exact = held.where("text_key <> first").select("doc_id", "text_key", "pos")
    varied = held.where("general IS NOT NULL").drop("first")
    recurring = C.cut(_recurring(varied, "general", F.lit(least_docs), F.col("n")), per_core=1)
    return exact.unionByName(C.hot_join(varied, recurring, "general", "texts", "text_key").where("text_key <> first").select("doc_id", "text_key", "pos"))


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, counts: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) without recurring lines; with ``counts`` also n_lines and n_dropped.

    A line of fewer than ``LEAST_WORDS`` words recurs in ``SHORT_DOCS`` different texts, one of more than
    ``LONG_WORDS`` in ``LONG_DOCS``, others and general templates in ``least_docs``. Every row stays; a text
    that loses all its lines is empty, and a null text stays null. The document of the smallest doc_id
    that holds a template keeps it, and so do documents of the same text; null ids come last. Repeated
    rows give repeated results. ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    others = {c: f"own_{k}" for k, c in enumerate(names) if c not in ("doc_id", "text")}  # so that no name clashes
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(o) for c, o in others.items())).withColumn("text_key", F.xxhash64(text))
    lines = C.cut(line_keys(own.select("doc_id", "text_key", text.alias("text"))))
    gone = dropped_lines(lines, least_docs).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone")).withColumnsRenamed({"doc_id": "gone_id", "text_key": "gone_key"})
    joined = own.join(gone, (F.col("text_key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    joined = joined.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    columns = [(F.col("kept_text") if c == "text" else F.length("kept_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(others.get(c, c))).alias(c) for c in names]
    if counts:
        columns += [F.when(text == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*columns)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row of ``documents``; see ``dedup_lines``."""
    return dedup_lines(C.pick(C.table(spark, sf_dir, "documents"), "doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def oracle(source: str = "documents") -> str:
    """The same rows in DuckDB's SQL, with texts and lists in place of hashes."""
    rest, many = f"(n - {LEAD_WORDS})", f"least(n - {LEAD_WORDS}, {FIELDS})"
    field = f"w[{LEAD_WORDS} + ({rest} * i) // {many} + 1:{LEAD_WORDS} + ({rest} * (i + 1)) // {many}]"
    need = f"CASE WHEN n > {LONG_WORDS} THEN {LONG_DOCS} WHEN n >= {LEAST_WORDS} THEN {LEAST_DOCS} ELSE {SHORT_DOCS} END"
    return rf"""
WITH docs AS (SELECT doc_id, text AS own, coalesce(text, '') AS text FROM {source}),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM docs)),
line AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
word AS (SELECT doc_id, text, pos, list_filter(regexp_split_to_array(regexp_replace(line, '\S*[0-9@]\S*', '<*>', 'g'), '\s+'), lambda x: x <> '') AS w FROM line),
keyed AS (SELECT doc_id, text, pos, w, len(w) AS n FROM word WHERE len(w) > 0),
whole AS (SELECT w, arg_min(text, d) AS first FROM (SELECT w, n, text, min(doc_id) AS d FROM keyed GROUP BY ALL) GROUP BY w, n HAVING count(*) >= {need}),
long AS (SELECT *, [n::VARCHAR] || w[1:{LEAD_WORDS}] AS leaf FROM keyed WHERE n >= {VARIABLE_WORDS}),
t AS (SELECT leaf, w, n, count(DISTINCT text) AS k FROM long WHERE leaf IN (SELECT leaf FROM long GROUP BY leaf HAVING count(DISTINCT w) > 1) GROUP BY ALL),
place AS (SELECT leaf, w, n, k, unnest(range({many})) AS i FROM t),
field AS (SELECT leaf, w, n, k, i, {field} AS field FROM place),
constant AS (SELECT leaf, i, field FROM field GROUP BY ALL HAVING sum(k) >= {LEAST_DOCS}),
pattern AS (SELECT leaf, w, n, list({{'i': i, 'field': field}} ORDER BY i) AS p FROM field JOIN constant USING (leaf, i, field) GROUP BY leaf, w, n HAVING 2 * count(*) >= {many}),
place2 AS (SELECT leaf, w, p, unnest(range({many})) AS i FROM pattern),
one AS (SELECT leaf, w, i, list_filter(p, lambda x: x.i <> i) AS other, list_filter(p, lambda x: x.i = i)::VARCHAR AS value FROM place2),
differ AS (SELECT w, list(i) AS v FROM one JOIN (SELECT leaf, i, other FROM one GROUP BY ALL HAVING count(DISTINCT value) > 1) USING (leaf, i, other) GROUP BY w),
fewer AS (SELECT leaf, w, n, p, list_filter(p, lambda x: NOT list_contains(v, x.i)) AS q FROM pattern LEFT JOIN differ USING (w)),
g AS (SELECT w, {{'leaf': leaf, 'parts': CASE WHEN 2 * len(q) >= {many} THEN q ELSE p END}} AS g FROM fewer),
general AS (SELECT doc_id, text, pos, g FROM long JOIN g USING (w)),
variable AS (SELECT g, arg_min(text, d) AS first FROM (SELECT g, text, min(doc_id) AS d FROM general GROUP BY ALL) GROUP BY g HAVING count(*) >= {LEAST_DOCS}),
gone AS (
  SELECT k.doc_id, k.text, pos FROM keyed k JOIN whole USING (w) WHERE k.text <> first
  UNION SELECT g.doc_id, g.text, pos FROM general g JOIN variable USING (g) WHERE g.text <> first),
drops AS (SELECT doc_id, text, list(pos) AS pos FROM gone GROUP BY ALL)
SELECT docs.doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(pos), 0)::BIGINT AS n_dropped,
  CASE WHEN pos IS NULL THEN own ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(pos, i)), chr(10)), '') END AS text
FROM docs LEFT JOIN drops USING (doc_id, text)"""
