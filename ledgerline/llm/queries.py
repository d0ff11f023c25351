"""Queries over the test tables for each operator of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, licenses, lm_score, merkle, mixing, neardup, pii, secrets, toxicity, warc, whitening
from .common import shared_dir, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]

#: DuckDB: lower-case A-Z alone.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: the base kinds and those the operator adds."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(r.kind) for r in secrets.RULES])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")
    base = F.filter("secret_spans", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("secret_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown("secret_spans").alias("spans"))


def _sql_spans(rank: int, rule: secrets.Rule) -> str:
    step = f"(?s)(.*?)(?:({rule.pattern})|\\z)".replace("'", "''")
    return f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, pos - length(hit) AS start, pos AS stop FROM (
  SELECT r, hit, m, sum(length(before) + length(hit)) OVER (PARTITION BY r ORDER BY k) AS pos FROM (
    SELECT r, generate_subscripts(b, 1) AS k, unnest(b) AS before, unnest(h) AS hit, unnest(g) AS m FROM (
      SELECT r, regexp_extract_all(text, '{step}', 1) AS b, regexp_extract_all(text, '{step}', 2) AS h, regexp_extract_all(text, '{step}', {2 + rule.group}) AS g FROM doc)))
  WHERE length(m) >= {rule.least}"""


_UNION = " UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(secrets.RULES))
SQL1 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({_UNION}),
of AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) AS spans FROM span GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN of USING (r)
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents under the counts of all other documents."""
    small_batches(spark)
    out = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_score", 3).alias("log_score"))


SQL2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_append(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> ''), chr(0)) AS h FROM documents),
pos AS (SELECT r, doc_id, len(h) AS n, unnest(range(1, len(h) + 1)) AS i, h FROM d),
p AS (SELECT r, doc_id, n, i, CASE WHEN i > 2 THEN h[i - 2] END AS u, CASE WHEN i > 1 THEN h[i - 1] END AS v, h[i] AS w FROM pos),
c AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS one,
  count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) AS two,
  count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) AS three, count(*) OVER () - n AS rest FROM p),
k AS (SELECT *, lag(one) OVER (PARTITION BY r ORDER BY i) AS one_before, lag(two) OVER (PARTITION BY r ORDER BY i) AS two_before FROM c),
s AS (SELECT r, doc_id, i > 2 AND three > 0 AS whole, CASE WHEN i > 2 AND three > 0 THEN ln(three / two_before)
  WHEN i > 1 AND two > 0 THEN ln(0.4 * two / one_before) WHEN one > 0 THEN ln(0.4 * 0.4 * one / rest) ELSE ln(0.4 * 0.4 * 0.4 / (rest + 1)) END AS s FROM k)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT whole) AS n_backoff, round(sum(s), 3) AS log_score FROM s GROUP BY r, doc_id
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings, through a log with drafts, edits, regenerations and deletions, fold, template and back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    log = chat.drafts_as_events(rows.unionByName(odd))
    back = chat.read_back(chat.render(chat.fold_events(log)))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Length of a text after escaping: one more for each <, [ and backslash.
_ESCAPED = r"length(regexp_replace({0}, '[<\[\\]', '..', 'g'))"

SQL3 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.BEGIN) + len(chat.TEXT) + len(chat.END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to seekable bundles and read back from them."""
    small_batches(spark)
    index = warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_dir(spark))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits are four characters of base32.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * j + 1}, 5))::BIGINT >> {shift}) & 31)::INT, 1)" for j in range(8) for shift in (15, 10, 5, 0)
)

SQL4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM d
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are similar to 0.8."""
    small_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


_WORDS5 = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"
SQL5 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS5.format('text')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM doc)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
often AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM often JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, least(doc.doc_id, coalesce(b, doc.doc_id)) AS component_id,
  doc.doc_id <= coalesce(b, doc.doc_id) AS kept FROM doc LEFT JOIN n ON n.doc_id = doc.doc_id LEFT JOIN least ON a = doc.doc_id
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in every whole document, with the places of hit words in the original text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), spans=True)
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"), F.array_join(c["spans"], ",").alias("spans"),
    )


_WORDS6 = "regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

#: Words with what stands before each of them.
_PIECES6 = "regexp_extract_all(" + _LOWER.format("text") + r", '[^0-9a-z\x{80}-\x{10FFFF}]*[0-9a-z\x{80}-\x{10FFFF}]+')"

#: Windows as strings; each document word run of a window's length is looked up among them.
SQL6 = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS6.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, text, row_number() OVER () AS r, {_WORDS6.format('text')} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
run AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, run.n, item_id FROM run JOIN win ON run.n = win.n AND run.s = win.s),
meets AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit),
covered AS (SELECT r, count(*) AS n_hit FROM meets GROUP BY r),
island AS (SELECT r, min(p) AS a, max(p) AS b FROM (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM meets) GROUP BY r, g),
piece AS (SELECT r, text, {_PIECES6} AS g FROM doc WHERE r IN (SELECT r FROM meets)),
place AS (SELECT r, i, sum(len(g)) OVER (PARTITION BY r ORDER BY i) AS stop, len(regexp_extract(g, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+$')) AS n
  FROM (SELECT r, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS g FROM piece)),
spans AS (SELECT r, string_agg((x.stop - x.n) || ',' || y.stop, ',' ORDER BY a) AS spans FROM island JOIN place x USING (r) JOIN place y USING (r) WHERE x.i = a AND y.i = b GROUP BY r),
of AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM doc LEFT JOIN covered USING (r) LEFT JOIN of USING (r) LEFT JOIN spans USING (r)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every whole document, from labels outside the held-out fold."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices that whole documents hold."""
    return licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


_VALUES8 = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.TEMPLATES.items())
_RUNS8 = "list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))"
_WORDS8 = r"regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

#: Shingles of each stretch of a document: a stretch starts at a block and is as long as its template asks for.
SQL8 = f"""
WITH t AS (SELECT license, {_RUNS8} AS s FROM (SELECT license, {_WORDS8.format('text')} AS w FROM (VALUES {_VALUES8}) v(license, text))),
ts AS (SELECT license, len(list_distinct(s)) AS n, CAST(ceil(1.25 * len(s) / {licenses.BLOCK}) AS BIGINT) + 1 AS blocks, unnest(list_distinct(s)) AS x FROM t),
d AS (SELECT r, doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM (SELECT r, doc_id, {_RUNS8} AS s FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS8.format('text')} AS w FROM documents))),
m AS (SELECT r, doc_id, license, n, blocks, x, (i - 1) // {licenses.BLOCK} AS b FROM d JOIN ts USING (x)),
st AS (SELECT r, doc_id, license, n, x, unnest(range(greatest(b - blocks + 1, 0), b + 1)) AS start FROM m),
c AS (SELECT r, doc_id, license, n, start, count(DISTINCT x) AS found FROM st GROUP BY ALL)
SELECT doc_id, license, max(found) AS n_found, n AS n_shingles FROM c GROUP BY r, doc_id, license, n HAVING max(found) >= 0.8 * n
"""


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by cosine, of every fiftieth vector."""
    small_batches(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources, with 3 times their size at most."""
    small_batches(spark)
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the base kinds, counted, and with them what the field adds."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal(docs, pii.train(docs)).select("doc_id", "pii_spans")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown("pii_spans").alias("spans"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents, every document's proof, and rows with tampered texts among those verified."""
    docs = table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    claimed = F.when(chosen, merkle.leaf_digest(columns | {"text": lower})).otherwise(merkle.leaf_digest(columns))
    manifest = merkle.build_manifest(docs, keep={"claimed": claimed})
    return merkle.verify(manifest, manifest.leaves).withColumnRenamed("id", "doc_id")


_FIELD12 = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF12 = "sha256(" + " || ".join(_FIELD12.format(c) for c in merkle.COLUMNS) + ")"

#: CRC-32 bit by bit: DuckDB has none.
_CRC12 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(substr(d, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""

#: Nodes by tree, level and place; siblings of each; each document's walk through its language's tree, then through the upper one.
_UP12 = """SELECT g, k + 1 AS k, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, max((n + 7) // 8) AS n FROM {0} WHERE n > 1 GROUP BY g, k, pos // 8"""
_SIB12 = """SELECT g, k, pos, coalesce(string_agg(h, '') OVER (PARTITION BY g, k, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, k, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {0} WHERE n > 1"""
_WALK12 = """SELECT w.r, w.g, w.k + 1 AS k, w.pos // 8 AS pos, sha256(s.l || w.h || s.r) AS h, w.proof || s.l || s.r AS proof FROM {0} w JOIN {1} s ON s.g = w.g AND s.k = w.k AND s.pos = w.pos"""

SQL12 = f"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, *, coalesce('=' || lang, '') AS g, CAST(doc_id AS VARCHAR) AS d FROM documents),
crc AS (SELECT r, xor({_CRC12}, 4294967295) % 3 = 0 AS chosen FROM doc WHERE d IS NOT NULL),
leaf AS (SELECT r, doc_id, g, {_LEAF12} AS h, {_LEAF12.replace("text", _LOWER.format("text"))} AS low FROM doc),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf),
node AS (SELECT g, 0 AS k, pos, h, n FROM base UNION ALL {_UP12.format("node")}),
sub AS (SELECT g, h FROM node WHERE n = 1),
topbase AS (SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM sub),
topnode AS (SELECT '' AS g, 0 AS k, pos, h, n FROM topbase UNION ALL {_UP12.format("topnode")}),
sib AS ({_SIB12.format("node")}),
topsib AS ({_SIB12.format("topnode")}),
walk AS (SELECT base.r, g, 0 AS k, pos, CASE WHEN coalesce(chosen, false) AND low IS NOT NULL THEN low ELSE h END AS h, '' AS proof FROM base LEFT JOIN crc USING (r) UNION ALL {_WALK12.format("walk", "sib")}),
ends AS (SELECT r, g, max_by(h, k) AS h, max_by(proof, k) AS proof FROM walk GROUP BY r, g),
topwalk AS (SELECT r, '' AS g, 0 AS k, t.pos, e.h, proof FROM ends e JOIN topbase t ON t.name = e.g UNION ALL {_WALK12.format("topwalk", "topsib")}),
topends AS (SELECT r, max_by(h, k) AS h, max_by(proof, k) AS proof FROM topwalk GROUP BY r),
whole AS (SELECT h FROM topnode WHERE n = 1)
SELECT doc_id, base.h AS leaf, sub.h AS subroot, whole.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = whole.h AS verified
FROM base JOIN sub USING (g) JOIN topends e USING (r), whole
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components, scaled to unit covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("deviation_digits")


QUERIES: dict[str, Query] = {"op1_secrets": op1_secrets, "op2_lm_score": op2_lm_score, "op3_chat": op3_chat, "op4_warc": op4_warc, "op5_near_duplicates": op5_near_duplicates, "op6_decontamination": op6_decontamination, "op7_toxicity": op7_toxicity, "op8_licenses": op8_licenses, "op9_nearest": op9_nearest, "op10_mixing": op10_mixing, "op11_personal_data": op11_personal_data, "op12_merkle": op12_merkle, "op13_whitening": op13_whitening}

ORACLES: dict[str, str] = {"op1_secrets": SQL1, "op2_lm_score": SQL2, "op8_licenses": SQL8, "op3_chat": SQL3, "op4_warc": SQL4, "op5_near_duplicates": SQL5, "op6_decontamination": SQL6, "op12_merkle": SQL12}
