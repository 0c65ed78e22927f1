"""The queries of this package, op1 to op13, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, common, decontaminate, exactdedup, jaccard, linededup, merkle, quality, sentencepiece_codec, sharding, substring, toxicity, urlfilter, whitening

#: The rules of op4 as (action, host, path prefix), and the added conversation of op7.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def tokenizer_file(spark: SparkSession | None = None, name: str = "piece_bpe_32k.model") -> str:
    """Path of a public tokenizer file: session setting plumbline.tokenizers, else the installed package's folder."""
    folder = spark.conf.get("plumbline.tokenizers", None) if spark else None
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id").select("doc_id", "slot", "shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).drop("runs")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summarise(common.read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label documents, not pages; labels of the document with a page's number stand in for its outcome."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    outcomes = common.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return urlfilter.filter_urls(common.read(spark, sf_dir, "pages"), outcomes, URL_RULES).drop("bound")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(common.read(spark, sf_dir, "documents")).drop("uid")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT CAST({PROBE_ID} AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{PROBE_TEXT}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    done = chatformat.format_conversations(rows.unionByName(probe)).withColumn("turns", chatformat.read_turns(F.col("formatted"))).withColumn("trained", chatformat.loss_text(F.col("pieces")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(common.read(spark, sf_dir, "documents"), k=4, percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(common.read(spark, sf_dir, "documents"), length=50)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(common.read(spark, sf_dir, "documents"), tokenizer_file(spark))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(common.read(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(common.read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # it imports this module

    found = [(int(k[2:].split("_")[0]), k) for k in globals() if k.startswith("op") and k[2:3].isdigit()]
    return {k: globals()[k] for _, k in sorted(found)} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_OP1 = f"""
WITH t AS (SELECT string_split('{{owners}}', ',') AS owners),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS s FROM documents)
SELECT doc_id, CAST(s AS INTEGER) AS slot, printf('shard-%02d', owners[s + 1]::INTEGER) AS shard FROM d, t
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda s: array_to_string(w[s : s + least(13, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS s, w FROM d, (SELECT DISTINCT size FROM iw)),
h AS (SELECT doc_id, s, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND array_to_string(w[s : s + dw.size - 1], ' ') = g),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("{low}", _LOWER)

#: Distances are between code points, while DuckDB's are between bytes: other characters than ASCII become control characters.
_OP3 = r"""
WITH RECURSIVE o AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
occ AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM o)),
solid AS (SELECT * FROM occ WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
d AS (SELECT DISTINCT line FROM solid),
ch AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS a FROM (SELECT DISTINCT unnest(string_split(regexp_replace(line, '[\x00-\x7F]', '', 'g'), '')) AS c FROM d WHERE length(line) >= {least}) WHERE c <> ''),
cc AS (SELECT a, (SELECT string_agg(chr(x::INTEGER), '' ORDER BY x) FROM (SELECT unnest(range(1, 32)) AS x) WHERE x NOT IN (9, 10, 13))[1 : length(a)] AS b FROM ch),
t AS (SELECT line, CASE WHEN a = '' THEN line ELSE translate(line, a, b) END AS k, length(line) AS n FROM d, cc WHERE length(line) >= {least}),
e AS (SELECT x.line AS p, y.line AS q FROM t x JOIN t y ON x.line < y.line AND y.n BETWEEN x.n - {edits} AND x.n + {edits} WHERE levenshtein(x.k, y.k) <= {edits}),
both_ways AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
r(line, root) AS (SELECT line, line FROM d UNION SELECT r.line, b.q FROM r JOIN both_ways b ON b.p = r.root),
c AS (SELECT line, min(root) AS comp FROM r GROUP BY line),
later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY comp ORDER BY doc_id, i) > 1 AS gone FROM solid JOIN c USING (line)),
k AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS kept, count(*) FILTER (gone) AS n_removed FROM occ LEFT JOIN later USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN k USING (doc_id)
""".replace("{least}", str(linededup.MIN_CHARS)).replace("{edits}", str(linededup.EDITS))

_OP4 = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS server FROM p),
h0 AS (SELECT DISTINCT server AS host, string_split(server, '.') AS a, regexp_full_match(server, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\]') AS ip FROM v),
h1 AS (SELECT host, ip, CASE WHEN ip THEN host WHEN len(a) >= 3 AND length(a[-1]) = 2 AND a[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN array_to_string(a[-3:], '.') ELSE array_to_string(a[-2:], '.') END AS domain FROM h0),
h2 AS (SELECT *, CASE WHEN contains(domain, '.') AND NOT ip THEN domain[strpos(domain, '.') + 1 :] ELSE domain END AS suffix FROM h1),
bh AS (SELECT h2.host, domain, suffix, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM v JOIN labels ON page_id = doc_id JOIN h2 ON h2.host = server GROUP BY ALL),
bd AS (SELECT domain, suffix, sum(s) AS ds, sum(n) AS dn FROM bh GROUP BY ALL),
bs AS (SELECT suffix, sum(ds) AS ss, sum(dn) AS sn FROM bd GROUP BY ALL),
g AS (SELECT *, (SELECT sum(ss) FROM bs) AS ts, (SELECT sum(sn) FROM bs) AS tn FROM bh JOIN bd USING (domain, suffix) JOIN bs USING (suffix)),
k AS (SELECT sum(s) / sum(n) AS rate,
  sum(n * (ss / sn - ts / tn) ** 2) / sum(n) AS v1, sum(n / sn) AS g1, sum(n * ts / tn * (1 - ts / tn)) / sum(n) AS b1,
  sum(n * (ds / dn - ss / sn) ** 2) / sum(n) AS v2, sum(n / dn) AS g2, sum(n * ss / sn * (1 - ss / sn)) / sum(n) AS b2,
  sum(n * (s / n - ds / dn) ** 2) / sum(n) AS v3, sum(n / n) AS g3, sum(n * ds / dn * (1 - ds / dn)) / sum(n) AS b3, sum(n) AS n FROM g),
ks AS (SELECT rate, least(200.0, greatest(1.0, b1 / greatest(v1 - b1 * g1 / n, 1e-9) - 1)) AS k1, least(200.0, greatest(1.0, b2 / greatest(v2 - b2 * g2 / n, 1e-9) - 1)) AS k2,
  least(200.0, greatest(1.0, b3 / greatest(v3 - b3 * g3 / n, 1e-9) - 1)) AS k3 FROM k),
m1 AS (SELECT h2.host, h2.domain, h2.suffix, (coalesce(ss, 0) + rate * k1) / (coalesce(sn, 0) + k1) AS ms, k2, k3 FROM h2 LEFT JOIN bs USING (suffix), ks),
m2 AS (SELECT m1.*, (coalesce(ds, 0) + ms * k2) / (coalesce(dn, 0) + k2) AS md FROM m1 LEFT JOIN bd USING (domain)),
m3 AS (SELECT m2.host AS server, (coalesce(s, 0) + md * k3) / (coalesce(n, 0) + k3) AS m, coalesce(n, 0) + k3 + 1 AS seen FROM m2 LEFT JOIN bh USING (host)),
r AS (SELECT page_id, v.host, v.path, m - {urlfilter.Z} * sqrt(m * (1 - m) / seen) AS bound,
  CASE WHEN (v.host = 'example.org' OR v.host LIKE '%.example.org') AND v.path LIKE '/en/1%' THEN 'example.org/en/1'
       WHEN (v.host = 'example.org' OR v.host LIKE '%.example.org') AND v.path LIKE '/es/%' THEN 'example.org/es/'
       WHEN (v.host = 'com' OR v.host LIKE '%.com') AND v.path LIKE '/fr/%' THEN 'com/fr/'
       WHEN (v.host = 'com' OR v.host LIKE '%.com') AND v.path LIKE '/de/%' THEN 'com/de/'
       WHEN (v.host = 'org' OR v.host LIKE '%.org') AND v.path LIKE '/%' THEN 'org/' END AS rule FROM v JOIN m3 USING (server))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= {urlfilter.THRESHOLD} THEN 'allow' ELSE 'block' END AS verdict FROM r
"""

_OP6 = f"""
WITH t AS (SELECT doc_id, {_RUNS} AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM t
"""

_OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<\|im_start\|>|<\|message\|>|<\|turn\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|endoftext\|>)', '#\1', 'g') AS esc,
      lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(esc) + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 33 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON b.x = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
""".replace("{low}", _LOWER)

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS s, w FROM d),
h AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h FROM win),
f AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM h JOIN f USING (h) WHERE doc_id > first_id),
g AS (SELECT doc_id, list(i) AS out FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(out), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN out IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(out, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

#: Levels by recursion: a tree's nodes until there is one; a node's siblings level by level; then each leaf folded upwards.
_OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, {h} AS leaf, CASE WHEN crc(doc_id) THEN {t} ELSE {h} END AS seen FROM documents),
l AS (SELECT *, coalesce('.' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
r(tree, lvl, i, n, digest) AS (SELECT tree, 0, i, n, leaf FROM l UNION ALL
  SELECT tree, lvl + 1, i // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY i)) FROM r WHERE n > 1 GROUP BY tree, lvl, i // 16),
sub AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM r WHERE n = 1),
q(lvl, i, n, digest) AS (SELECT 0, i, n, subroot FROM sub UNION ALL
  SELECT lvl + 1, i // 16, max((n + 15) // 16), sha256(string_agg(digest, '' ORDER BY i)) FROM q WHERE n > 1 GROUP BY lvl, i // 16),
nodes AS (SELECT tree, lvl, i, n, digest FROM r UNION ALL SELECT 'top', lvl, i, n, digest FROM q),
steps AS (SELECT a.tree, a.lvl, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS pre, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS post
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
f(id, k, phase, tree, lvl, i, digest, proof) AS (SELECT row_number() OVER (), 0, 0, tree, 0, i, seen, '' FROM l UNION ALL
  SELECT f.id, k + 1, CASE WHEN s.lvl IS NULL THEN 1 ELSE phase END, CASE WHEN s.lvl IS NULL THEN 'top' ELSE f.tree END, CASE WHEN s.lvl IS NULL THEN 0 ELSE f.lvl + 1 END,
         CASE WHEN s.lvl IS NULL THEN sub.i ELSE f.i // 16 END, CASE WHEN s.lvl IS NULL THEN f.digest ELSE sha256(s.pre || f.digest || s.post) END, CASE WHEN s.lvl IS NULL THEN proof ELSE proof || s.pre || s.post END
  FROM f LEFT JOIN steps s ON s.tree = f.tree AND s.lvl = f.lvl AND s.i = f.i LEFT JOIN sub ON sub.tree = f.tree WHERE s.lvl IS NOT NULL OR phase = 0),
done AS (SELECT id, digest AS folded_root, proof FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
o AS (SELECT doc_id, leaf, tree, row_number() OVER () AS id FROM l)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM o JOIN done USING (id) JOIN sub USING (tree), (SELECT digest AS root FROM q WHERE n = 1)
"""


def _op13() -> str:
    part = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {bits}), 4294967295)"
    return _OP13.replace("{h}", leaf("text")).replace("{t}", leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")).replace("crc(doc_id)", f"{crc} % 5 = 0")


def oracle_sql() -> dict[str, str]:
    owners = ",".join(map(str, sharding.fill(sharding.SHARDS)))
    out = {"op1_sharding": _OP1.replace("{owners}", owners), "op2_decontamination": _OP2, "op3_line_dedup": _OP3, "op4_url_filter": _OP4, "op6_exact_dedup": _OP6, "op7_chat_format": _OP7, "op8_ngram_jaccard": _OP8, "op9_substring_dedup": _OP9, "op13_merkle_manifest": _op13()}
    import corpus_pipeline

    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
