"""The registered query of every operator, over whole tables, with its SQL twin where SQL can express it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import bpe, conversations, decontaminate, exact, html, langid, licences, minhash, periods, pii, topk, urls, warc
from rankspark.llm.common import table

UPPER, LOWER = urls.UPPER, urls.LOWER


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: 3-word shingles, similarity 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP1_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x<>'') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w)>=3 THEN array_to_string(w[i:i+2],' ') ELSE array_to_string(w,' ') END AS s FROM w, unnest(range(1, greatest(len(w)-2, least(len(w),1))::BIGINT+1)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s=b.s AND a.doc_id<b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id=x JOIN n b ON b.doc_id=y WHERE 100*shared >= 85*(a.n+b.n-shared)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT ways.y, r.root FROM r JOIN ways ON ways.x=r.id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.id=doc_id GROUP BY doc_id, n"""

def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the selected languages with their proportions."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans by kind, and all spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii.digests(F.col("found")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every benchmark item found in a document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the fields of its metadata and conversion records."""
    return warc.derived(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, paragraph, family, probability, confirmed_by of every licence paragraph."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256*x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


#: The rules (verdict, host, path) of the URL query (fixed values).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The block list of the URL query: sites of six unwanted names under each public suffix (fixed values).
BLOCKED = [f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
           for end in ("com", "net", "org")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES, urls.keys(spark, BLOCKED))


OP9_SQL = rf"""WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://')+3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(says, h, q) AS (VALUES {', '.join(map(str, RULES))}),
f AS (SELECT page_id, host, path, arg_max(h||q, length(h||q)) AS rule, arg_max(says, length(h||q)) AS says FROM p
 LEFT JOIN rules ON (host=h OR ends_with(host, '.'||h)) AND starts_with(path, q) GROUP BY page_id, host, path),
l AS (SELECT *, list_has_any(list_transform(range(1, 1+len(string_split(host,'.'))), lambda i: array_to_string(string_split(host,'.')[i:], '.')), {BLOCKED}) AS listed FROM f)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM l"""

def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged conversations."""
    return conversations.repair(table(spark, sf_dir, "conversations"), damage=True)


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, bit by bit."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda x, c: xor(x >> 8,
 list_reduce(list_prepend(xor(x, c) & 255, range(8)), lambda y, _: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))))"""


def _op11_sql() -> str:
    """The forward pass as a recursion over turns; a state is the least {cost, audit, repaired lines} that reaches it."""
    def edit(state: str, cost: str, initial: str, line: str | None) -> str:
        lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'l': {lines}}} END"

    def to(states: str, role: str) -> str:
        kept = [f"CASE WHEN free AND role[1] = '{role[0]}' THEN {edit(f's{i}', 'extra', 'K', 'said')} END" for i in states]
        given = [f"CASE WHEN free THEN {edit(f's{i}', '3 + extra', 'R', f"'{role}:' || text")} END" for i in states]
        return ", ".join(kept + given * (role != "system"))
    inserted = f"""SELECT conv_id, i, s0, s1, s2, least(s3, {edit('s2', '3', 'I', "'assistant:'")}) AS s3 FROM (
 SELECT conv_id, i, s0, s1, s3, least(s2, {', '.join(edit(f's{i}', '3', 'I', "'user:'") for i in (0, 1, 3))}) AS s2 FROM """
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {_crc32('key')} % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
e AS (SELECT conv_id, i, role, text, role || ':' || text AS said, fault IS NULL OR fault = 'truncated' AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
start AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR[]) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR[]) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, l VARCHAR[]) AS s3 FROM conversations GROUP BY conv_id),
r AS ({inserted} start)
 UNION ALL
 {inserted} (
 SELECT e.conv_id, e.i, {edit('s0', '4', 'D', None)} AS s0, least({edit('s1', '4', 'D', None)}, {to('0', 'system')}) AS s1,
 least({edit('s2', '4', 'D', None)}, {to('013', 'user')}) AS s2, least({edit('s3', '4', 'D', None)}, {to('2', 'assistant')}) AS s3
 FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i + 1))),
best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS b FROM r GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
 count_if(fault = 'truncated')::BIGINT AS truncated, count_if(before IS NOT NULL AND before[1] || role[1] NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.l, chr(10))) AS repaired_sha256
FROM best LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""


OP11_SQL = _op11_sql()


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (g ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of the partly periodic documents."""
    return periods.periodic(table(spark, sf_dir, "documents"), plant=True)


OP13_SQL = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, len(w) AS n, {_crc32('doc_id::VARCHAR')} AS h, h // 10 AS g FROM documents),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM d),
t AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM e)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM m) GROUP BY doc_id, p, island HAVING count(*) >= greatest(3 * p, 6 - p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS n_runs, first({{'s': start, 'l': length, 'p': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS best,
 string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (FROM r WHERE r.doc_id = t.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
 sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_pii": op2_pii, "op3_decontaminate": op3_decontaminate, "op4_warc": op4_warc, "op5_main_text": op5_main_text, "op6_licences": op6_licences, "op7_byte_bpe": op7_byte_bpe, "op8_top_k": op8_top_k, "op9_url_filter": op9_url_filter,
           "op10_language_id": op10_language_id, "op11_repair": op11_repair, "op12_exact_dedup": op12_exact_dedup, "op13_periods": op13_periods}
ORACLES = {"op1_minhash_dedup": OP1_SQL, "op8_top_k": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_repair": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_periods": OP13_SQL}
