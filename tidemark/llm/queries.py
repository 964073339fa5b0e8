"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, chat, pieces
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.licenses import CUE, LEAST, TEMPLATES, TEXTS, scan_licenses
from tidemark.llm.frames import materialize
from tidemark.llm.line_templates import CONSTANT_PERCENT, DEPTH, FIELD, MIN_TEXTS, dedup_lines
from tidemark.llm.near_dups import PERCENT, near_duplicates
from tidemark.llm.periodic import LEAST as LEAST_RUN
from tidemark.llm.periodic import TIMES, periodic_runs, run_digests
from tidemark.llm.quality import KEEP_PERCENT, LINE_LIMIT, quality_rules
from tidemark.llm.repeats import MIN_WORDS, repeated_passages
from tidemark.llm.shards import record_size, shard_rows
from tidemark.llm.simhash import simhash_duplicates
from tidemark.llm.wrappers import main_text


def piece_model() -> str:
    """The file of the 32k piece model: a public vocabulary that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_register
def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@_register
def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    decoded = pieces.decode(pieces.encode(docs, piece_model()).drop("text"), piece_model())
    return decoded.select("doc_id", *pieces.digests(decoded))


@_register
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(docs).select(*names)


# \n-split lines, their normal form and the words of a text, as DuckDB writes them
SQL["op9_quality_rules"] = f"""
WITH w AS (SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM documents),
n AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars FROM w),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, unnest([ws[i:i+2] for i in range(1, len(ws) - 1)]) AS gram
  FROM w WHERE len(ws) >= 3),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(o) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
ll AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM l),
f AS (SELECT * FROM ll WHERE norm <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
freq AS (SELECT source, norm FROM f GROUP BY source, norm HAVING count(DISTINCT text) > {LINE_LIMIT}),
dep AS (
  SELECT f.doc_id FROM f LEFT JOIN freq ON f.source IS NOT DISTINCT FROM freq.source AND f.norm = freq.norm GROUP BY f.doc_id
  HAVING 100 * sum(CASE WHEN freq.norm IS NULL THEN len(string_split(f.norm, ' ')) ELSE 0 END)
    < {KEEP_PERCENT} * sum(len(string_split(f.norm, ' ')))),
base AS (
  SELECT d.doc_id, n_words, coalesce(word_chars, 0) AS word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM documents d JOIN n USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM dep) AS kept
FROM base
"""


@_register
def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    found = main_text(table(spark, sf, "pages")).withColumnRenamed("id", "page_id")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@_register
def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema))
    ranks = pieces.load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return chat.read_back(chat.format_chat(turns, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


SHARDS = 40


@_register
def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shard_rows(table(spark, sf, "documents").select("doc_id", "text"), SHARDS).select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_register
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "tiled_words", "item_words", F.size("tiles").cast("long").alias("n_tiles"))


@_register
def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@_register
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))


# The documents have no path: one is made from source and id, three directories deep; round numbers lie higher up, and
# every tenth document, if it has a line that speaks of licences, is a licence file of its directory.
_PATH = """concat_ws('/', coalesce(source, 'unknown'),
  CASE WHEN doc_id % 1000 <> 0 THEN CAST(doc_id {div} 1000 AS {text}) END,
  CASE WHEN doc_id % 100 <> 0 THEN CAST((doc_id {div} 100) % 10 AS {text}) END,
  concat(CASE WHEN doc_id % 10 = 0 AND {notes} THEN 'LICENSE-' ELSE '' END, CAST(doc_id AS {text}), '.txt'))"""


@_register
def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _PATH.format(div="div", text="string", notes=f"text rlike '{CUE}'")
    files = table(spark, sf, "documents").selectExpr("doc_id", "text", f"{path} as path")
    return scan_licenses(files)


_TEMPLATE_TEXTS = [(n, t) for n, _, t in TEMPLATES] + [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(_TEMPLATE_TEXTS))
_WEIGHT = "(1 + ln(tf)) * (1 + ln(((SELECT sum(n) FROM nt) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)))"
SQL["op10_license_scan"] = f"""
WITH f AS (
  SELECT doc_id, text, {_PATH.format(div="//", text="VARCHAR", notes=f"regexp_matches(text, '{CUE}')")} AS path
  FROM documents),
n AS (
  SELECT doc_id, path, named, CASE WHEN position('/' IN path) > 0 THEN regexp_replace(path, '/[^/]*$', '') END AS directory,
    array_to_string([x for x in string_split(text, chr(10)) if regexp_matches(x, '{CUE}')], chr(10)) AS notice,
    CASE WHEN named THEN text END AS whole
  FROM (SELECT *, regexp_matches(string_split(path, '/')[-1], '(?i)^(licen[cs]e|copying|notice)') AS named FROM f)),
nt AS (
  SELECT notice, sum(k) AS n
  FROM (SELECT notice, 1 AS k FROM n UNION ALL SELECT whole, CASE WHEN notice <> '' THEN 0 ELSE 1 END FROM n) WHERE notice <> '' GROUP BY notice),
tk AS (SELECT notice, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS term FROM nt),
tm AS (SELECT notice, term, count(*) AS tf FROM tk GROUP BY notice, term),
idf AS (SELECT term, sum(n) AS df FROM tm JOIN nt USING (notice) GROUP BY term),
v AS (SELECT notice, term, {_WEIGHT} AS w FROM tm JOIN idf USING (term)),
tp(template, license, text) AS (VALUES {_TEMPLATE_ROWS}),
tt AS (SELECT template, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM tp),
tw AS (SELECT template, term, {_WEIGHT} AS v FROM (SELECT template, term, count(*) AS tf FROM tt GROUP BY 1, 2) LEFT JOIN idf USING (term)),
sc AS (
  SELECT notice, license, round(dot / (norm * size), 9) AS score
  FROM (SELECT notice, template, sum(w * v) AS dot FROM v JOIN tw USING (term) GROUP BY 1, 2)
  JOIN (SELECT notice, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1) USING (notice)
  JOIN (SELECT template, sqrt(sum(v * v)) AS size FROM tw GROUP BY 1) USING (template) JOIN tp USING (template)),
hit AS (SELECT * FROM sc WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY score DESC, license DESC) = 1),
k AS (
  SELECT doc_id, path, named, directory, license AS own_license, score
  FROM (
    SELECT n.*, license, round(score, 6) AS score FROM n LEFT JOIN hit ON n.notice = hit.notice
    UNION ALL SELECT n.*, license, round(score, 6) FROM n JOIN hit ON n.whole = hit.notice)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, license DESC NULLS LAST) = 1),
src AS (
  SELECT directory AS above, own_license AS inherited FROM k WHERE named AND own_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, own_license DESC) = 1),
up AS (
  SELECT directory, depth, array_to_string(string_split(directory, '/')[1:depth], '/') AS above
  FROM (SELECT directory, unnest(range(1, len(string_split(directory, '/')) + 1)) AS depth FROM (SELECT DISTINCT directory FROM k))),
near AS (
  SELECT directory, above, inherited FROM up JOIN src USING (above)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY depth DESC) = 1)
SELECT doc_id, path, own_license, score, coalesce(own_license, inherited) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'self' ELSE above END AS licensed_by
FROM k LEFT JOIN near USING (directory)
"""


@_register
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of all documents; every tenth, by a hash of its id, first gets a period planted from some word on."""
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id",
        "coalesce(text, '') as text",
        "crc32(cast(cast(doc_id as string) as binary)) as h",
    )
    words = docs.withColumn(
        "ws", F.expr("case when h % 10 = 0 then filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '') else array() end")
    )
    placed = words.selectExpr("*", "cast(size(ws) as long) as n", "h div 10 as g").selectExpr("*", "if(n > 0, g % n, 0) as a")
    placed = placed.selectExpr("*", "1 + (n - a) div (3 + g % 8) as p")
    # the words before the place, then the period over and over
    tail = "slice(flatten(array_repeat(slice(ws, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))"
    planted = f"case when n > 0 then array_join(concat(slice(ws, 1, int(a)), {tail}), ' ') else text end as text"
    return run_digests(periodic_runs(placed.selectExpr("doc_id", planted)), "doc_id")


@_register
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    models = public_tokenizers.path("byte_bpe_50k.json"), piece_model()
    pairs = alignment.link_pairs(*models)
    digests = alignment.aligned_digests(table(spark, sf, "documents"), *models, pairs, ["doc_id"])
    return alignment.link_scores(materialize(digests), pairs)


@_register
def op13_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_duplicates(table(spark, sf, "documents"))
    bits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), bits.alias("fingerprint"), "component_id", "kept")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = "[x for x in regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+') if x <> '']"

SQL["op5_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p+4], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM both_in t JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * t.k >= {PERCENT} * (x.k + y.k - t.k)),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(k, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON node = doc_id LEFT JOIN n USING (doc_id)
"""

# CRC-32 by its table of 256 values; then words, planted words, pairs of equal 5-word grams by lag, and their stretches
_GRAM = 5
SQL["op11_periodic_runs"] = f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws,
    xor(4294967295, list_reduce([ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')], lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]),
      4294967295::BIGINT)) AS h
  FROM documents, crc),
g AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN [ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] for i in range(n)] ELSE ws END AS ws FROM p),
k AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1:i + {_GRAM}], ' ') AS gram
  FROM (SELECT *, unnest(range(0, n - {_GRAM} + 1)) AS i FROM w WHERE n >= {LEAST_RUN})),
r AS (SELECT doc_id, n, i, md5(gram) AS gram FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
m AS (SELECT y.doc_id, y.i, y.i - x.i AS lag FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND {TIMES} * (y.i - x.i) <= x.n),
s AS (
  SELECT doc_id, lag, min(i) - lag AS start, count(*) + {_GRAM} - 1 + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS z FROM m) GROUP BY doc_id, lag, z),
runs AS (
  SELECT doc_id, start, length, min(lag) AS period FROM s WHERE length >= greatest({LEAST_RUN}, {TIMES} * lag) GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    min([-length, start, period]) AS longest
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
  FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS word FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest[2] AS start, -longest[1] AS length, longest[3] AS period,
  (-1000 * longest[1]) // longest[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op8_suffix_array_dedup"] = f"""
WITH w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS ws FROM documents),
v AS (
  SELECT doc_id, p, md5(array_to_string(ws[p + 1:p + {MIN_WORDS}], ' ')) AS k
  FROM (SELECT *, unnest(range(0, len(ws) - {MIN_WORDS} + 1)) AS p FROM w WHERE len(ws) >= {MIN_WORDS})),
hit AS (SELECT doc_id, p FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING min(doc_id) < max(doc_id))),
o AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit),
g AS (SELECT *, sum(CASE WHEN p <= before + {MIN_WORDS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS stretch FROM o)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, max(p) + {MIN_WORDS} - min(p) AS n_words FROM g GROUP BY doc_id, stretch
"""

_BARE = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL["op1_line_dedup"] = f"""
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS x FROM t),
k AS (
  SELECT text, i, [CASE WHEN regexp_matches(y, '[0-9]') THEN '{FIELD}' ELSE y END
    for y in regexp_split_to_array({_BARE}, '[\\x20\\x09-\\x0D]+')] AS ws FROM l WHERE {_BARE} <> ''),
f AS (SELECT text, i, ws, len(ws) || ' ' || array_to_string(ws[1:{DEPTH}], ' ') AS leaf FROM k),
big AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_TEXTS}),
d AS (SELECT leaf, ws, count(DISTINCT text) AS n FROM f JOIN big USING (leaf) GROUP BY leaf, ws),
c AS (SELECT leaf, ws, n, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
z AS (SELECT leaf, ws, p, CASE WHEN word <> '{FIELD}' AND sum(n) OVER (PARTITION BY leaf, p, word) >= {MIN_TEXTS} THEN word END AS word FROM c),
u AS (
  SELECT leaf, ws, CASE WHEN 100 * count(word) < {CONSTANT_PERCENT} * count(*) THEN ws ELSE list(coalesce(word, '{FIELD}') ORDER BY p) END AS template
  FROM z GROUP BY leaf, ws),
hit AS (SELECT leaf, template FROM f JOIN u USING (leaf, ws) GROUP BY leaf, template HAVING count(DISTINCT text) >= {MIN_TEXTS}),
gone AS (SELECT DISTINCT text, i FROM f JOIN u USING (leaf, ws) JOIN hit USING (leaf, template)),
kept AS (
  SELECT text, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS rest,
    count(*) AS n_lines, count(gone.i) AS n_dropped
  FROM l LEFT JOIN gone USING (text, i) GROUP BY text)
SELECT doc_id, rest AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM documents LEFT JOIN kept USING (text)
"""
