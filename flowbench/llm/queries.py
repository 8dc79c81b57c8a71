"""The registered queries of the corpus operators: thin digests of their results over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm import byte_bpe, license_scan, merkle, mixing, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filters, variants, warc
from flowbench.llm.common import ascii_lower, table
from flowbench.llm.exact_dedup import DigestIndex
from flowbench.plans.catalog import query
from flowbench.session import shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [
    url_filters.UrlRule("org", "/", True),
    url_filters.UrlRule("example.org", "/es/", False),
    url_filters.UrlRule("example.org", "/en/1", False),
    url_filters.UrlRule("com", "/fr/", True),
    url_filters.UrlRule("com", "/de/", False),
]
SHARDS = 24
TOXIC_FROM = 0.7

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# An address: host, path and query without scheme, default port, fragment and utm parameters. The pages of the given tables
# declare no canonical links or refreshes, so aliases are the urls of one address here; tests follow links.
_OP1 = rf"""
WITH u AS (
    SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url,
           {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), r(host, path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), own AS (
    SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS said
    FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id
), n AS (
    SELECT u.page_id, u.host, u.path, own.rule, own.said, u.html,
           CASE WHEN u.host <> '' THEN regexp_replace(u.host, ':(80|443)$', '') || CASE WHEN u.path = '' THEN '/' ELSE u.path END ||
               CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS node
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS q FROM u) u
    LEFT JOIN own USING (page_id)
), said AS (
    SELECT node, max(said = 'allow') AS allowed FROM n WHERE said IS NOT NULL AND node IS NOT NULL GROUP BY node
)
SELECT n.page_id, n.host, n.path, n.rule,
       CASE WHEN coalesce(n.said = 'allow', said.allowed, true) THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN n.said IS NOT NULL THEN 'rule' WHEN said.allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM n LEFT JOIN said USING (node)
"""


@query("op1_url_filters", _OP1)
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_byte_bpe")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    tokens = byte_bpe.read_ranks(docs.sparkSession, RANKS)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_OP3 = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""


@query("op3_exact_dedup", _OP3)
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, shared_folder(spark, "digest-index"), buckets=32)
    found = index.absorb(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_toxicity")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


@query("op5_warc")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


@query("op6_simhash")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_sharding")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)


@query("op8_license_scan")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.transform("phrases", lambda p: p["label"])
    both = F.concat(base, F.transform("spans", lambda s: s["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("phrases", lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(both).alias("labels"), "score",
    )


_OP9 = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), base AS (
    SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars, w,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_marks,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w
), words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM base
), windows AS (
    SELECT doc_id, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS g
    FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), marked AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE g IS NOT NULL
), gaps AS (
    SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS own FROM marked WHERE n > 1
), repeated AS (
    SELECT doc_id, sum(own) AS n FROM gaps GROUP BY doc_id
), m AS (
    SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words, n_marks, n_lines
    FROM base LEFT JOIN repeated USING (doc_id)
), b AS (
    SELECT *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (2 * n_symbols > n_words)::int + 8 * (100 * n_dup_lines > 30 * n_lines)::int
              + 16 * (word_chars > 25 * n_words OR word_chars < 2 * n_words)::int + 32 * (n_marks > n_words)::int AS fail_bits FROM m
)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
       n_repeat_words::bigint AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::bigint AS fail_bits FROM b
"""


@query("op9_quality_rules", _OP9)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v2").alias("kept"), "fail_bits",
    )


_ABLATIONS = _OP9.rsplit("SELECT doc_id, n_words::bigint", 1)[0] + """
SELECT rule, bit, count_if(fail_bits >> bit & 1 = 1) AS failed, count_if(fail_bits = 1 << bit) AS "only" FROM b,
(VALUES ('few_words', 0), ('repeated_windows', 1), ('symbols', 2), ('repeated_lines', 3), ('word_length', 4), ('exclamations', 5)) r(rule, bit) GROUP BY ALL
"""


@query("quality_ablations", _ABLATIONS)
def _quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy rejects, and what it alone rejects, from the bits of the ledger."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")


@query("op10_mixing")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# Unsigned CRC-32 of a text's bytes, from its hex form ``{}``; ``crc_table`` is a CTE of one row.
_CRC_TABLE = """crc_table(tab) AS MATERIALIZED (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i)
)"""
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length({0}) // 2 + 1),
    lambda k: 16 * (strpos('0123456789ABCDEF', substr({0}, 2 * k - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr({0}, 2 * k, 1)) - 1)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"""

_NETSTRING = "coalesce(strlen({0}) || ':' || {0}, '-')"
_OP12 = f"""
WITH RECURSIVE {_CRC_TABLE}, texts AS (
    SELECT doc_id, lang, doc_id::varchar AS d, source, n_chars::varchar AS n, text, {_CRC.format("hex(doc_id::varchar)")} % 3 = 0 AS touched FROM documents, crc_table
), parts AS (
    SELECT *, {_NETSTRING.format("d")} || {_NETSTRING.format("source")} || {_NETSTRING.format("lang")} || {_NETSTRING.format("n")} AS front,
           CASE WHEN touched THEN {_LOWER.format("text")} ELSE text END AS changed FROM texts
), leaf AS (
    SELECT *, sha256(front || {_NETSTRING.format("text")}) AS h, sha256(front || {_NETSTRING.format("changed")}) AS claim FROM parts
), leaves AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS r,
           count(*) OVER (PARTITION BY lang) AS n, h, claim FROM leaf
), nodes AS (
    SELECT tree, 0 AS lvl, r AS i, h, n FROM leaves
    UNION ALL
    SELECT tree, any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, i // 8
), subroots AS MATERIALIZED (
    SELECT tree, h AS subroot, lvl AS levels, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS lvl, r AS i, subroot AS h, n FROM subroots
    UNION ALL
    SELECT any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 7) // 8 FROM tops WHERE n > 1 GROUP BY i // 8
), around AS MATERIALIZED (
    SELECT a.tree, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL
), around_top AS MATERIALIZED (
    SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL
), steps AS MATERIALIZED (
    SELECT v.tree, v.r AS leaf, a.lvl, a.l, a.r FROM leaves v JOIN around a ON a.tree = v.tree AND a.i = v.r >> (3 * a.lvl)
    UNION ALL
    SELECT v.tree, v.r, s.levels + a.lvl, a.l, a.r FROM leaves v JOIN subroots s USING (tree) JOIN around_top a ON a.i = s.r >> (3 * a.lvl)
), folds AS (
    SELECT tree, r AS leaf, 0 AS lvl, claim AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT f.tree, f.leaf, f.lvl + 1, sha256(s.l || f.h || s.r), f.proof || s.l || s.r FROM folds f JOIN steps s ON s.tree = f.tree AND s.leaf = f.leaf AND s.lvl = f.lvl
), last AS (
    SELECT tree, leaf, arg_max(h, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM folds GROUP BY ALL
), whole AS (
    SELECT h AS root FROM tops WHERE n = 1
)
SELECT v.doc_id, v.h AS leaf, s.subroot, root, sha256(last.proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves v JOIN subroots s USING (tree) JOIN last ON last.tree = v.tree AND last.leaf = v.r, whole
"""


@query("op12_merkle_manifest", _OP12)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    row = lambda text: merkle.row_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, row(ascii_lower(F.col("text"))))
    manifest = merkle.build(docs, row(F.col("text")), F.col("lang"), F.col("doc_id"), claim=tampered, carry=("doc_id",))
    root = F.lit(manifest.root())
    subroots = manifest.trees.select("tree", F.lower(F.hex("subroot")).alias("subroot"))
    proofs = merkle.prove(manifest).select("carried.doc_id", "tree", "leaf", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"))
    return proofs.join(subroots, "tree").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


_OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
    SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT run, n, {_CRC.format("hex(doc_id::varchar || ':' || run)")} AS h FROM runs, crc_table WHERE length(run) >= 5
), words AS MATERIALIZED (
    SELECT word, sum(n)::bigint AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), shorter AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT DISTINCT s.word AS a, w.word AS b, w.n AS b_n FROM shorter s JOIN words w ON w.word = s.rest
    UNION
    SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest
    UNION
    SELECT s.word, t.word, t.n FROM shorter s JOIN shorter t ON s.i = t.i AND s.rest = t.rest AND s.word <> t.word
), best AS (
    SELECT a, count(*) AS n_near, max(b_n) AS form_n, arg_min(b, (-b_n, encode(b))) AS form FROM near GROUP BY a
), formed AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
    FROM words LEFT JOIN best ON a = word
), steps AS (
    SELECT word, word AS reached, 0 AS k FROM formed
    UNION ALL
    SELECT s.word, f.form, s.k + 1 FROM steps s JOIN formed f ON f.word = s.reached WHERE f.form IS NOT NULL
), roots AS (
    SELECT word, arg_max(reached, k) AS root FROM steps GROUP BY word
)
SELECT f.word, f.form, roots.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots USING (word)
"""


@query("op13_spelling_variants", _OP13)
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.letter_runs(table(spark, sf_dir, "documents"))
    slipped = runs.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run"))))
    word = F.when(F.col("h") % 97 == 0, F.concat(F.expr("substring(run, 1, cast(h % length(run) AS int))"), F.expr("substring(run, cast(h % length(run) AS int) + 2)"))).otherwise(F.col("run"))
    return variants.variants(variants.count_words(slipped, word))


@query("op11_suffix_dedup")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
