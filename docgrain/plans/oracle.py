"""The SQL forms of the registered queries, for an independent engine; written from the operators' definitions."""

from __future__ import annotations

from docgrain.functions import stem

CHUNKS = r"""
cut AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2048) / 1792.0)) AS BIGINT) * 1792 + 1, 1792)) AS s, text FROM documents WHERE length(text) > 0),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_idx, s AS "start", least(s + 2048, length(text)) AS "end", substring(text, s + 1, 2048) AS text,
    doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk_id
  FROM cut WHERE regexp_matches(substring(text, s + 1, 2048), '\S'))"""

BM25 = (
    CHUNKS
    + r""",
words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM words),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ask AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
bm AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * greatest(dl, 1) / avgdl))), 9) AS score
  FROM ask JOIN df USING (term) JOIN post USING (term), stats GROUP BY query_id, chunk_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0)"""
)


def hash_vector(text: str, dim: int = 8) -> str:
    """SQL for the hash components of a text, normalised."""
    parts = ", ".join(f"CAST('0x' || substr(sha256('{i}:' || {text}), 1, 8) AS BIGINT) / 4294967296.0e0 * 2.0e0 - 1.0e0" for i in range(dim))
    return f"[{parts}]"


HYBRID = (
    BM25
    + f""",
cv AS (SELECT chunk_id, {hash_vector("text")} AS v FROM chunks),
qv AS (SELECT item_id AS query_id, {hash_vector("text")} AS v FROM benchmark),
dense AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(qv.v, cv.v), 6) + 0.0e0 AS score FROM qv, cv)),
lists AS (SELECT 'dense' AS list_id, * FROM dense WHERE rank <= 20 UNION ALL SELECT 'sparse', * FROM sparse WHERE rank <= 20)"""
)

QRELS = "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

#: Normalised text: straight quotes, lower case, joined hyphens, words and single spaces.
NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(translate({t}, '“”‘’', '""''''')), '([\p{{L}}\p{{N}}_])-[ \t]*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def normal(t: str) -> str:
    return NORMAL.format(t=t)


TURNS = "t AS (SELECT conv_id AS doc_id, turn AS page_no, role, text FROM conversations)"
STEM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '^.*/', ''))), '\.pdf$', ''), '\.txt$', ''), '\s+', ' ', 'g'))"
RATINGS = "f AS (SELECT event_id AS feedback_id, user_id AS query_id, [-1, 1, 2, 3, 4, 5][event_id % 6 + 1] AS rating, event_type, value FROM events)"
LOGS = "l AS (SELECT conv_id AS query_id, arg_min(text, turn) AS question, arg_max(role, turn) AS route, count(*) AS n_turns, [conv_id, conv_id * 2, conv_id + count(*) * 1000] AS cited FROM conversations GROUP BY conv_id)"
VERSIONS = """now AS (SELECT doc_id, sha256(text) AS sha256 FROM documents),
points AS (SELECT * FROM now UNION ALL SELECT doc_id, sha256(sha256 || ':old') FROM now WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
KS = (1, 3, 5, 10)
#: What is asked for a passage: all its words, or the first three.
ASKED, THREE_WORDS = "lower(text), '[a-z0-9]+'))) AS term FROM benchmark", "lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[a-z0-9]+'))) AS term FROM benchmark"
JUDGED = (
    BM25
    + f""",
{QRELS},
items AS (SELECT item_id || ':' || doc_id AS query_id, item_id, doc_id, text AS span, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS bucket FROM gold JOIN benchmark USING (item_id)),
res AS (
  SELECT i.query_id, i.item_id, i.doc_id, bucket, rank, coalesce(contains({normal("s.text")}, {normal("span")}), false) AS rel
  FROM items i LEFT JOIN (SELECT query_id, doc_id, rank, text FROM sparse JOIN chunks USING (chunk_id) WHERE rank <= 10) s ON s.query_id = i.item_id AND s.doc_id = i.doc_id),
m AS (
  SELECT query_id, bucket, coalesce(1.0e0 / min(rank) FILTER (rel), 0) AS mrr"""
    + "".join(
        f""", count(*) FILTER (rel AND rank <= {k}) / {k}.0e0 AS "p@{k}", CAST(count(*) FILTER (rel AND rank <= {k}) > 0 AS INT)::DOUBLE AS "hit@{k}",
    coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= {k}) / list_sum(list_transform(range(1, count(*) FILTER (rel AND rank <= {k}) + 1), lambda i: 1 / log2(i + 1))), 0) AS "ndcg@{k}\""""
        for k in KS
    )
    + """
  FROM res GROUP BY query_id, bucket)"""
)
PAIRED = """j AS (SELECT l.doc_id AS id, quality::DOUBLE AS ragas, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1), 6) AS deepeval
  FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND length(text) >= 200)"""
LABELLED = "d AS (SELECT * FROM documents JOIN labels USING (doc_id))"


def fused(score: str, extra: str = "") -> str:
    return f"WITH {HYBRID}, s AS ({score}) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank{extra} FROM s"


def rrf(base: int) -> str:
    return f"SELECT query_id, chunk_id, round(sum(1.0e0 / (60 + rank - 1 + {base})), 9) AS score, string_agg(list_id, ',' ORDER BY list_id) || ',rrf' AS provenance FROM lists GROUP BY query_id, chunk_id"


STOP = r"""stop AS (SELECT unnest(string_split('agreement agreements clause clauses contract does include includes which what whose jurisdiction govern governs the and for with from this that under between required measured appears grant governing law parties date effective expiration renewal term notice period to terminate exclusivity audit rights cap on liability non compete ip assignment ownership insurance minimum commitment license anti termination convenience transferable affiliate agency co branding cobranding collaboration cooperation consulting development distributor endorsement franchise hosting ip joint venture license maintenance manufacturing marketing non compete noncompete outsourcing promotion reseller service services sponsorship strategic alliance supply transportation', ' ')) AS token)"""
#: Filters by the titles of documents: query_id, docs (sorted), kind.
FILTERS = (
    STOP
    + r""",
asking AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS token FROM benchmark),
cat AS (SELECT DISTINCT doc_id, coalesce(lang, 'Unknown') AS kind, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:5], ' ')), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS token FROM documents),
h AS (SELECT query_id, token, doc_id, kind FROM asking JOIN cat USING (token) WHERE length(token) >= 4 AND token NOT IN (SELECT token FROM stop)),
g AS (SELECT query_id, token, count(*) AS n, list(doc_id ORDER BY doc_id) AS docs, list(kind ORDER BY doc_id) AS kinds FROM h GROUP BY query_id, token HAVING count(*) <= 5),
o AS (SELECT query_id, list(DISTINCT docs[1]) FILTER (n = 1) AS singles, arg_min({'d': docs, 'k': kinds}, (n, token)) AS least FROM g GROUP BY query_id),
rule AS (SELECT query_id, least.d AS docs, CASE WHEN len(list_distinct(least.k)) = 1 THEN least.k[1] END AS kind FROM o WHERE singles IS NULL OR len(singles) <= 1)"""
)



def sql_porter() -> str:
    """The stemmer as common tables: voc (word) -> st0, st1, ..., stems (word, idx)."""
    tests = {name: f"regexp_matches({{k}}, '{p}')" if p else "true" for name, p in stem.CONDITIONS.items()}

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def step(rules: list, word: str = "w") -> str:
        cases = []
        for ending, new, condition in sorted(rules, key=lambda r: -len(r[0])):
            own = condition == "two, s or t"
            kept = cut(len(ending) - len(new) if own else len(ending))
            cases.append(f"WHEN suffix(w, '{ending}') THEN CASE WHEN {tests[condition].format(k=kept)} THEN {kept if own else f"{kept} || '{new}'"} ELSE w END")
        return f"CASE {' '.join(cases)} ELSE w END"

    kept = "left(w, length(w) - CASE WHEN suffix(w, 'ing') THEN 3 ELSE 2 END)"
    mended = f"CASE WHEN regexp_matches({kept}, '(at|bl|iz)$') THEN {kept} || 'e' WHEN length({kept}) > 1 AND right({kept}, 1) = left(right({kept}, 2), 1) AND regexp_matches({kept}, '[^aeiouylsz]$') THEN left({kept}, length({kept}) - 1) WHEN {tests['short'].format(k=kept)} THEN {kept} || 'e' ELSE {kept} END"
    past = f"CASE WHEN NOT suffix(w, 'eed') AND regexp_matches(w, '(ed|ing)$') AND {tests['vowel'].format(k=kept)} THEN {mended} ELSE {step(stem.PAST[:1])} END"
    e = f"CASE WHEN suffix(w, 'e') AND ({tests['two'].format(k=cut(1))} OR {tests['just one'].format(k=cut(1))} AND NOT {tests['short'].format(k=cut(1))}) THEN {cut(1)} ELSE w END"
    ll = f"CASE WHEN suffix(w, 'll') AND {tests['two'].format(k=cut(1))} THEN {cut(1)} ELSE w END"
    steps = [step(stem.PLURALS), past, step(stem.LAST_Y), step(stem.DOUBLE_ENDINGS), step(stem.ENDINGS), step(stem.LAST_ENDINGS), e, ll]
    out = "st0 AS (SELECT word, word AS w FROM voc)"
    for k, made in enumerate(steps, 1):
        out += f",\nst{k} AS (SELECT word, {made} AS w FROM st{k - 1})"
    return out + f",\nstems AS (SELECT word AS term, CASE WHEN length(word) > 2 THEN w ELSE word END AS idx FROM st{len(steps)})"


SPARSE = (
    CHUNKS
    + r""",
toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunks),
asks AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
voc AS (SELECT term AS word FROM (SELECT term FROM toks UNION SELECT term FROM asks) WHERE term NOT IN ("""
    + ", ".join(f"'{w}'" for w in stem.STOP_WORDS)
    + f""")),
{sql_porter()},
tfs AS (SELECT chunk_id, idx, count(*) AS tf FROM toks JOIN stems USING (term) GROUP BY ALL),
enc AS (SELECT chunk_id, idx, round(tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / 256.0e0)), 9) AS weight FROM tfs JOIN (SELECT chunk_id, sum(tf) AS dl FROM tfs GROUP BY chunk_id) USING (chunk_id))"""
)

CLAIMS = f"""{TURNS}, z AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last FROM t),
s AS (SELECT doc_id AS query_id, unnest(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g'))) AS claim, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]*'), 1) - 1 AS claim_no FROM z WHERE page_no = last),
w AS (SELECT *, list_distinct(list_filter(string_split({normal("claim")}, ' '), lambda w: length(w) > 2)) AS words FROM s),
c AS (SELECT * FROM w WHERE len(words) > 0),
h AS (SELECT DISTINCT doc_id AS query_id, page_no AS seq, unnest(string_split({normal("text")}, ' ')) AS word FROM z WHERE page_no < last),
n AS (SELECT query_id, claim_no, seq, count(*) AS n FROM (SELECT query_id, claim_no, unnest(words) AS word FROM c) JOIN h USING (query_id, word) GROUP BY ALL),
b AS (SELECT query_id, claim_no, max(n) AS n, arg_max(seq, (n, -seq)) AS seq FROM n GROUP BY ALL),
k AS (SELECT query_id, claim_no, claim, round(coalesce(n, 0) / len(words), 6) AS score, seq, round(coalesce(n, 0) / len(words), 6) >= 0.3 AS supported FROM c LEFT JOIN b USING (query_id, claim_no))"""

ORACLE: dict[str, str] = {
    "K11_generation_table": f"""WITH {LABELLED},
g AS (SELECT source, lang, concat_ws('/', source, lang) AS path, CAST(count(*) AS INT) AS n, round(avg(quality), 6) AS q, round(avg(toxic), 6) AS t, round(avg(n_chars), 0) AS c FROM d GROUP BY source, lang),
r AS (SELECT path, source, lang, n, substring(md5(path), 1, 8) AS git_sha, t AS faithfulness_ragas, q AS groundedness, CASE WHEN n % 2 = 1 THEN ' / ' || format('{{:.3f}}', round(t, 3)) ELSE '' END AS abstain,
  format('{{:.1f}}s', round(c / 1000.0, 1)) AS latency_p50, CASE WHEN n % 2 = 1 THEN q END AS faithfulness_deepeval FROM g)
SELECT path, n, git_sha, faithfulness_ragas, groundedness, abstain, latency_p50, faithfulness_deepeval,
  '| ' || concat_ws(' | ', coalesce(source, ''), coalesce(lang, ''), n, abstain, latency_p50, git_sha, format('{{:.3f}}', round(faithfulness_ragas, 3)), format('{{:.3f}}', round(groundedness, 3)), '', coalesce(format('{{:.3f}}', round(faithfulness_deepeval, 3)), '')) || ' |' AS line FROM r""",
    "X2_flat_records": f"""WITH {TURNS}, z AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last FROM t),
l AS (SELECT doc_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY page_no)) AS contexts_md5 FROM z WHERE page_no < last GROUP BY doc_id)
SELECT d.doc_id AS id, d.source AS question, md5(z.text) AS answer_md5, toxic = 1 AS expected_abstain, lang AS expected_route, contexts_md5, n * 10 AS latency_ms, n AS llm_calls
FROM documents d JOIN labels USING (doc_id) JOIN z ON z.doc_id = d.doc_id AND page_no = last LEFT JOIN l ON l.doc_id = d.doc_id""",
    "G7_supported_claims": f"WITH {CLAIMS} SELECT query_id, CAST(claim_no AS INT) AS claim_no, md5(claim) AS claim_md5, score, seq, supported FROM k",
    "G7_claim_support": f"""WITH {CLAIMS},
q AS (SELECT query_id, round(avg(score), 6) AS score, count(*) FILTER (NOT supported) = 0 AS grounded, coalesce(string_agg(claim, '|' ORDER BY claim_no) FILTER (NOT supported), '') AS u FROM k GROUP BY query_id)
SELECT DISTINCT z.doc_id AS query_id, coalesce(score, 0) AS score, coalesce(grounded, false) AS grounded, md5(coalesce(u, 'empty')) AS unsupported_md5 FROM z LEFT JOIN q ON q.query_id = z.doc_id WHERE page_no = last""",
    "G6_calls": """WITH c AS (SELECT conv_id AS query_id, turn, least(length(text), 400) AS n FROM conversations),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY turn) - n AS before FROM c)
SELECT query_id, CAST(before // 1600 AS INT) AS call, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_chars FROM u GROUP BY ALL""",
    "K6_refused_writes": """WITH r AS (SELECT event_id AS feedback_id, user_id AS query_id, event_id % 8 - 1 AS rating, event_id % 11 = 0 AS odd, event_type FROM events),
q AS (SELECT DISTINCT conv_id FROM conversations),
w AS (SELECT feedback_id, query_id, CASE WHEN rating NOT IN (-1, 1, 2, 3, 4, 5) THEN 'rating ' || rating WHEN odd THEN 'unknown tags ' || event_type WHEN conv_id IS NULL THEN 'unknown query_id ' || query_id END AS reason
  FROM r LEFT JOIN q ON conv_id = query_id)
SELECT * FROM w WHERE reason IS NOT NULL""",
    # One document after another takes what is left, as a recursion over the failing ones.
    "T3_ratio_gate": r"""WITH RECURSIVE d AS (
  SELECT doc_id, source AS kind, lang AS grp, quality, toxic, length(regexp_replace(lower(text), '\s', '', 'g')) AS a, floor(n_chars * 0.86) AS b FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, coalesce(a > 0 AND b > 0 AND a / b BETWEEN 0.97 AND 1.03, false) AS ok FROM d),
f AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM r WHERE toxic = 1 AND NOT ok),
c AS (SELECT * FROM r WHERE toxic = 0 AND quality = 1 AND ok),
g AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS taken
  UNION ALL
  SELECT g.k + 1, list_append(any_value(g.taken), arg_min(c.doc_id, (CASE WHEN c.kind IS NOT DISTINCT FROM f.kind THEN 0 WHEN c.grp IS NOT DISTINCT FROM f.grp THEN 1 ELSE 2 END, c.doc_id)) FILTER (c.doc_id IS NOT NULL))
  FROM g JOIN f ON f.k = g.k + 1 LEFT JOIN c ON NOT list_contains(g.taken, c.doc_id) GROUP BY g.k),
t AS (SELECT taken FROM g ORDER BY k DESC LIMIT 1)
SELECT doc_id, doc_id AS final, NULL::VARCHAR AS note FROM r WHERE toxic = 1 AND ok
UNION ALL SELECT doc_id, taken[k], CASE WHEN taken[k] IS NULL THEN 'no_replacement ' || doc_id ELSE 'replaced ' || doc_id || ' -> ' || taken[k] END FROM f, t""",
    "E5_sparse_encodings": f"WITH {SPARSE} SELECT * FROM enc",
    "E5_sparse_search": f"""WITH {SPARSE},
q AS (SELECT DISTINCT query_id, idx FROM asks JOIN stems USING (term)),
df AS (SELECT idx, count(*) AS df FROM enc GROUP BY idx),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5e0) / (df + 0.5e0)) * weight), 6) AS score FROM q JOIN df USING (idx) JOIN enc USING (idx) GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 20""",
    "S2_text_pages": "SELECT doc_id, 1 AS page_no, length(text) AS n_chars, sha256(text) AS sha256 FROM documents",
    "S3_inventory": r"""WITH p AS (SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS folder FROM pages)
SELECT folder, CASE folder WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' END AS kind, count(*) AS n, folder NOT IN ('fr', 'de', 'en') AS unmapped FROM p GROUP BY folder""",
    "S4_clause_lookup": r"""WITH r AS (SELECT lower(p_name) AS stem, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, p_partkey FROM part)
SELECT DISTINCT stem, key, max(p_partkey) OVER (PARTITION BY stem) AS last_by_stem, min(p_partkey) OVER (PARTITION BY key) AS first_by_key FROM r""",
    "S6_scan_chunks": f"WITH {CHUNKS} SELECT chunk_id, doc_id, length(text) AS n_chars FROM chunks",
    "S7_registry_list": "SELECT doc_id, lang AS kind, source, n_chars FROM documents ORDER BY lang, doc_id",
    "S7_registry_get": "SELECT event_id AS doc_id, source, n_chars FROM events LEFT JOIN documents ON doc_id = event_id",
    "S7_feedback_of_query": f"WITH {RATINGS} SELECT feedback_id, query_id, rating FROM f WHERE query_id = 7 ORDER BY feedback_id",
    "S10_work_list": "SELECT doc_id, source AS path, lang AS kind FROM documents ORDER BY doc_id LIMIT 100",
    "K11_results_table": f"""WITH {LABELLED} SELECT concat_ws('/', source, lang) AS path, source AS profile, lang AS split, CAST(count(*) AS INT) AS n, substring(md5(concat_ws('/', source, lang)), 1, 12) AS config_hash, '' AS git_sha,
  round(avg(quality), 6) AS mrr, round(avg(toxic), 6) AS "hit@5", CAST(NULL AS DOUBLE) AS "r@5" FROM d GROUP BY source, lang""",
    "M8_standing_run": f"""WITH {LABELLED}, w AS (SELECT DISTINCT source AS profile, lang AS split, md5(CASE WHEN quality = 1 THEN text ELSE 'none' END) AS config_hash FROM d)
SELECT profile, split, config_hash, (SELECT CAST(arg_max(doc_id, (md5(text) IS NOT DISTINCT FROM config_hash, doc_id)) AS VARCHAR) FROM documents WHERE source = profile AND lang = split) AS path FROM w""",
    "S8_remaining": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "S9_catalog": "SELECT doc_id, source AS name, lang AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR n_chars > 0",
    "K1_upsert": "SELECT doc_id, CAST(coalesce(q, -1) AS INT) AS state FROM documents FULL JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)",
    "K2_other_versions_deleted": f"WITH {VERSIONS} SELECT points.* FROM points JOIN now USING (doc_id, sha256)",
    "K3_counts_by_version": f"WITH {VERSIONS} SELECT doc_id, sha256, count(*) AS n FROM points GROUP BY ALL",
    "K4_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "K5_orphans": "SELECT doc_id AS query_id FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)",
    "K6_violations": "SELECT event_id, CAST(CAST(floor(value) AS BIGINT) % 9 - 2 AS INT) AS rating FROM events WHERE CAST(floor(value) AS BIGINT) % 9 - 2 NOT IN (-1, 1, 2, 3, 4, 5)",
    "K7_export": f"""WITH {RATINGS}, {LOGS},
c AS (SELECT query_id, unnest(cited) AS doc_id, generate_subscripts(cited, 1) AS pos FROM l),
k AS (SELECT query_id, coalesce(lang, '(unknown)') AS kind, min(pos) AS pos FROM c LEFT JOIN documents USING (doc_id) GROUP BY ALL),
o AS (SELECT query_id, string_agg(kind, ',' ORDER BY pos, kind) AS agreement_types FROM k GROUP BY query_id)
SELECT feedback_id, query_id, rating, event_type || ',good' AS tags, route, md5(question) AS question_md5, agreement_types FROM f JOIN l USING (query_id) JOIN o USING (query_id)""",
    "T1_strip_headers": rf"""WITH {TURNS},
u AS (
  SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - 1 AS unit_no, text
  FROM (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t) WHERE trim(text) <> ''),
k AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key, max(unit_no) OVER (PARTITION BY doc_id, page_no) AS last_no FROM u),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
firsts AS (SELECT doc_id, key FROM k JOIN n USING (doc_id) WHERE unit_no = 0 AND n >= 3 GROUP BY doc_id, key HAVING count(*) >= greatest(2, (any_value(n) + 1) // 2)),
lasts AS (SELECT doc_id, key FROM k JOIN n USING (doc_id) WHERE unit_no = last_no AND n >= 3 GROUP BY doc_id, key HAVING count(*) >= greatest(2, (any_value(n) + 1) // 2))
SELECT doc_id, page_no, unit_no, md5(text) AS text_md5 FROM k
WHERE NOT (unit_no = 0 AND (doc_id, key) IN (SELECT doc_id, key FROM firsts)) AND NOT (unit_no = last_no AND (doc_id, key) IN (SELECT doc_id, key FROM lasts))
  AND NOT regexp_matches(trim(text), '(?i)^-?\s*(?:page\s+)?[0-9]{{1,3}}(?:\s*(?:of|/)\s*[0-9]{{1,3}})?\s*-?$')""",
    "T2_ratio": r"""WITH c AS (SELECT doc_id, length(regexp_replace(lower(text), '\s', '', 'g')) AS pdf_chars, n_chars AS txt_chars FROM documents)
SELECT doc_id, pdf_chars, txt_chars, CASE WHEN pdf_chars > 0 AND txt_chars > 0 THEN round(pdf_chars / txt_chars, 9) END AS ratio,
  coalesce(pdf_chars > 0 AND txt_chars > 0 AND pdf_chars / nullif(txt_chars, 0) BETWEEN 0.97 AND 1.03, false) AS ratio_ok FROM c""",
    "T4_pending": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic <> 1)",
    "T5_exact_duplicates": "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS first_key, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents",
    "T7_point_ids": f"""WITH {CHUNKS},
h AS (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || sha256(text) || ':' || chunk_idx || ':sig')) AS h FROM chunks)
SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((CAST('0x' || substr(h, 17, 1) AS INT) & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "T8_document_ids": f"SELECT page_id, {STEM.format(c='url')} AS doc_id, contains(url, '/uploads/') AS is_upload FROM pages",
    "C1_joined_pages": f"WITH {TURNS}, p AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"start\" FROM t) SELECT doc_id, page_no, \"start\", \"start\" + length(text) AS \"end\" FROM p",
    "C2_fixed_windows": f'WITH {CHUNKS} SELECT doc_id, chunk_idx, "start", "end", md5(text) AS text_md5 FROM chunks',
    "C4_pages_covered": rf"""WITH {TURNS},
p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t),
w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM t GROUP BY doc_id),
r AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(text) - 256) / 224.0)) AS BIGINT) * 224 + 1, 224)) AS a, text FROM w WHERE length(text) > 0),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_idx, a, least(a + 256, length(text)) AS b FROM r WHERE regexp_matches(substring(text, a + 1, 256), '\S'))
SELECT c.doc_id, chunk_idx, coalesce(min(page_no), 1) AS page_start, coalesce(max(page_no), 1) AS page_end, count(page_no) AS n_blocks
FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND p.s < c.b AND p.s + length(p.text) > c.a GROUP BY c.doc_id, chunk_idx""",
    "C5_header_and_tokens": "WITH h AS (SELECT doc_id, CASE WHEN coalesce(lang, '') <> '' THEN lang || chr(10) || text ELSE text END AS text FROM documents) SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS est_tokens, md5(text) AS text_md5 FROM h",
    "E1_hash_dense": f"WITH v AS (SELECT doc_id, {hash_vector('text')} AS v FROM documents), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT doc_id, {', '.join(f'round(v[{i + 1}] / n, 9) AS v{i}' for i in range(8))} FROM n",
    "E2_hash_sparse": r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents)
SELECT doc_id, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 10000 AS idx, count(*) AS weight FROM w WHERE w <> '' GROUP BY ALL""",
    "E6_normalised": """WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM n)
SELECT vec_id, unnest(range(len(e))) AS at, round(unnest(list_transform(e, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END)), 9) AS x FROM s""",
    "A12_corpus_statistics": f"WITH {BM25} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM df, stats",
    "P1_filter": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang, source",
    "P2_unknown_type": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) || ',Unknown' AS types FROM documents GROUP BY source",
    "P3_named_documents": r"""WITH stop AS (SELECT unnest(string_split('agreement agreements clause clauses contract does include includes which what whose jurisdiction govern governs the and for with from this that under between required measured appears grant governing law parties date effective expiration renewal term notice period to terminate exclusivity audit rights cap on liability non compete ip assignment ownership insurance minimum commitment license anti termination convenience transferable affiliate agency co branding cobranding collaboration cooperation consulting development distributor endorsement franchise hosting ip joint venture license maintenance manufacturing marketing non compete noncompete outsourcing promotion reseller service services sponsorship strategic alliance supply transportation', ' ')) AS token),
ask AS (SELECT DISTINCT conv_id || ':' || turn AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS token FROM conversations WHERE role = 'user'),
cat AS (SELECT DISTINCT page_id AS doc_id, regexp_extract(url, '^https?://[^/]+/([a-z]*)', 1) AS kind, unnest(regexp_extract_all(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '[a-z0-9]+')) AS token FROM pages),
h AS (SELECT query_id, token, doc_id, kind FROM ask JOIN cat USING (token) WHERE length(token) >= 4 AND token NOT IN (SELECT token FROM stop)),
g AS (SELECT query_id, token, count(*) AS n, list(doc_id ORDER BY doc_id) AS docs, list(kind ORDER BY doc_id) AS kinds FROM h GROUP BY query_id, token HAVING count(*) <= 5),
o AS (SELECT query_id, list(DISTINCT docs[1]) FILTER (n = 1) AS singles, arg_min({'d': docs, 'k': kinds}, (n, token)) AS least FROM g GROUP BY query_id)
SELECT query_id, array_to_string(least.d, ',') AS doc_ids, CASE WHEN len(list_distinct(list_filter(least.k, lambda x: x <> ''))) = 1 THEN list_filter(least.k, lambda x: x <> '')[1] END AS kind
FROM o WHERE singles IS NULL OR len(singles) <= 1""",
    "P4_named_type": "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE', 'PROMO') THEN p_type[1] || lower(p_type[2:]) END AS kind FROM part",
    "P6_merged_filters": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'asked' ELSE lang END AS kind FROM documents LEFT JOIN labels USING (doc_id)",
    "Q1_dense_top_k": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM e),
a AS (SELECT label, pos, round(avg(x), 6) AS x FROM p GROUP BY label, pos),
c AS (SELECT label AS query_id, list(x ORDER BY pos) AS v FROM a GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(c.v, e.v), 6) + 0.0e0 AS score FROM c, e)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 20""",
    "Q2_sparse_top_k": rf"""WITH {CHUNKS},
dt AS (SELECT chunk_id, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 10000 AS idx, count(*) AS weight FROM (SELECT chunk_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM chunks) WHERE w <> '' GROUP BY ALL),
qt AS (SELECT query_id, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 10000 AS idx, count(*) AS q FROM (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
df AS (SELECT idx, count(*) AS df FROM dt GROUP BY idx), n AS (SELECT count(*) AS n FROM chunks),
s AS (SELECT query_id, chunk_id, round(sum(q * ln(1.0e0 + (n - df + 0.5e0) / (df + 0.5e0)) * weight), 6) AS score FROM qt JOIN df USING (idx) JOIN dt USING (idx), n GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 20""",
    "Q3_bm25": f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM sparse WHERE rank <= 20",
    "Q4_server_hybrid": f"SELECT query_id, chunk_id, score, rank FROM ({fused(rrf(0))}) WHERE rank <= 10",
    "Q5_client_hybrid": f"SELECT query_id, chunk_id, score, rank FROM ({fused(rrf(1))}) WHERE rank <= 10",
    "F1_rrf_provenance": fused(rrf(1), ", provenance"),
    "F2_dbsf": fused(
        "SELECT query_id, chunk_id, round(sum(CASE WHEN sd IS NULL OR lo = hi THEN 0.5e0 ELSE (score - (mean - 3 * sd)) / (6 * sd) END), 9) AS score FROM (SELECT *, stddev_samp(score) OVER w AS sd, avg(score) OVER w AS mean, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lists WINDOW w AS (PARTITION BY query_id, list_id)) GROUP BY query_id, chunk_id"
    ),
    "F3_weighted": fused(
        "SELECT query_id, chunk_id, round(sum(0.5e0 * CASE WHEN lo = hi THEN 0.5e0 ELSE (score - lo) / (hi - lo) END), 9) AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lists WINDOW w AS (PARTITION BY query_id, list_id)) GROUP BY query_id, chunk_id"
    ),
    "R1_cut": f"WITH {BM25} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM sparse WHERE rank <= 5",
    "R2_lexical_rerank": rf"""WITH {BM25},
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark),
s AS (SELECT query_id, chunk_id, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, ws)) / len(q), 6) END AS score FROM sparse JOIN q USING (query_id) JOIN words USING (chunk_id) WHERE rank <= 20)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "R3_question_filters": f"""WITH {FILTERS}
SELECT query_id, array_to_string(docs, ',') AS doc_ids, CASE WHEN kind = 'Unknown' THEN kind ELSE kind || ',Unknown' END AS kinds, CAST(len(docs) AS BIGINT) AS n_allowed FROM rule""",
    "R3_filtered_pipeline": f"""WITH {BM25.split("ask AS")[0]}
{FILTERS},
asks AS (SELECT item_id AS query_id, 0 AS nth, text FROM benchmark UNION ALL SELECT item_id, 1, {normal("text")} FROM benchmark WHERE {normal("text")} <> text),
ask AS (SELECT query_id, nth, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM asks),
pairs AS (SELECT query_id, unnest(docs) AS doc_id FROM rule),
may AS (SELECT query_id, chunk_id FROM pairs JOIN chunks USING (doc_id) UNION ALL SELECT item_id, chunk_id FROM benchmark, chunks WHERE item_id NOT IN (SELECT query_id FROM rule)),
bm AS (
  SELECT query_id, nth, chunk_id, round(sum(ln(1 + (stats.n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * greatest(dl, 1) / avgdl))), 9) AS score
  FROM ask JOIN df USING (term) JOIN post USING (term) JOIN may USING (query_id, chunk_id), stats GROUP BY query_id, nth, chunk_id),
cv AS (SELECT chunk_id, {hash_vector("text")} AS v FROM chunks),
qv AS (SELECT query_id, nth, {hash_vector("text")} AS v FROM asks),
dn AS (SELECT query_id, nth, chunk_id, round(list_cosine_similarity(qv.v, cv.v), 6) + 0.0e0 AS score FROM qv JOIN may USING (query_id) JOIN cv USING (chunk_id)),
lists AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20
  UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= 20),
each AS (SELECT query_id, nth, chunk_id, round(sum(1.0e0 / (60 + rank)), 9) AS score FROM lists GROUP BY ALL),
top AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY score DESC, chunk_id) AS rank FROM each QUALIFY rank <= 20)),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark),
s AS (SELECT query_id, chunk_id, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, ws)) / len(q), 6) END AS score FROM top JOIN q USING (query_id) JOIN words USING (chunk_id))
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "R4_merged_rounds": f"WITH {HYBRID} SELECT query_id, chunk_id, list_id, rank + CASE WHEN list_id = 'dense' THEN 0 ELSE 1000 END AS seq FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_id) = 1",
    "J6_relevant_documents": f"WITH {QRELS} SELECT * FROM gold",
    "M1_question_metrics": f"WITH {JUDGED} SELECT query_id, bucket, round(mrr, 6) AS mrr"
    + "".join(f', round("{m}@{k}", 6) AS "{m}@{k}"' for k in KS for m in ("p", "hit", "ndcg"))
    + " FROM m",
    "M2_span_recall": f"""WITH {JUDGED}, x AS (SELECT item_id AS query_id, doc_id, CAST(bool_or(rel) AS INT)::DOUBLE AS hit FROM res GROUP BY item_id, doc_id)
SELECT query_id, round(avg(hit), 6) AS r, max(hit) AS r_any, min(hit) AS r_all FROM x GROUP BY query_id""",
    "A1_aggregate": f"""WITH {JUDGED}, u AS (SELECT 'overall' AS "by", 'all' AS key, * FROM m UNION ALL SELECT 'bucket', bucket, * FROM m)
SELECT "by", key, round(avg(mrr), 6) AS mrr, round(avg("hit@5"), 6) AS "hit@5", round(avg("ndcg@10"), 6) AS "ndcg@10", count(*) AS n FROM u GROUP BY "by", key""",
    "A8_top_misses": f"""WITH {JUDGED.replace(ASKED, THREE_WORDS)},
f AS (SELECT DISTINCT query_id AS item_id, doc_id FROM sparse JOIN chunks USING (chunk_id) WHERE rank <= 10)
SELECT query_id AS id, i.doc_id, CASE WHEN f.doc_id IS NULL THEN 'exact_term_miss' WHEN "hit@10" = 0 THEN 'chunk_boundary' WHEN "hit@5" = 0 THEN 'reranker_demoted_gold' ELSE 'header_noise' END AS tag, round(m.mrr, 6) AS mrr
FROM m JOIN items i USING (query_id) LEFT JOIN f ON f.item_id = i.item_id AND f.doc_id = i.doc_id WHERE "hit@10" < 1 ORDER BY "hit@10", m.mrr, query_id LIMIT 20""",
    "A2_answer_metrics": f"""WITH {LABELLED},
s AS (SELECT quality = 1 AS route, n_chars > 500 AS predicted, toxic = 1 AS want, contains(text, 'idiot') OR contains(text, 'clown') AS did,
  CASE WHEN quality = 1 THEN n_chars > 100 END AS ok, CASE WHEN toxic = 0 THEN least(1.0e0, n_chars / 4000.0e0) END AS g, n_chars, doc_id % 7 AS calls FROM d),
o AS (SELECT list(n_chars ORDER BY n_chars) AS v FROM s)
SELECT count(*)::DOUBLE AS n, round(avg(CAST(route = predicted AS INT)), 6) AS route_accuracy, round(coalesce(count(*) FILTER (want AND did) / nullif(count(*) FILTER (did), 0), 0), 6) AS abstention_precision,
  round(coalesce(count(*) FILTER (want AND did) / nullif(count(*) FILTER (want), 0), 0), 6) AS abstention_recall, round(coalesce(avg(CAST(ok AS INT)), 0), 6) AS citation_validity,
  round(coalesce(avg(g), 0), 6) AS mean_groundedness, round(avg(calls), 6) AS llm_calls_per_query,
  (SELECT v[CAST(round_even(0.5e0 * (len(v) - 1), 0) AS BIGINT) + 1]::DOUBLE FROM o) AS latency_p50_ms, (SELECT v[CAST(round_even(0.95e0 * (len(v) - 1), 0) AS BIGINT) + 1]::DOUBLE FROM o) AS latency_p95_ms FROM s""",
    "A3_nearest_rank": "WITH o AS (SELECT list(value ORDER BY value) AS v FROM events) SELECT CAST(p AS INT) AS p, v[CAST(round_even(p / 100.0e0 * (len(v) - 1), 0) AS BIGINT) + 1] AS value FROM o, (SELECT unnest([1, 25, 50, 75, 95, 99]) AS p)",
    "A4_spearman": """WITH r AS (SELECT l_quantity AS x, round(l_extendedprice, 0) AS y FROM lineitem),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS ry FROM r)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM k""",
    "J4_samples": f"""WITH r AS (SELECT doc_id AS id, [x FOR x IN string_split(text, chr(10))[2:] IF x <> ''] AS contexts, string_split(text, chr(10))[2:2] AS quotes, text, source, n_chars FROM documents)
SELECT id, len(contexts) AS n_contexts, substring(text, 1, 50) AS answer, quality || ' kept' AS reference, CASE WHEN id % 3 > 0 THEN source ELSE 'corpus_technical' END AS predicted_route, n_chars < 100 AS abstained,
  CASE WHEN len(quotes) > 0 THEN trim(quotes[1], ' ') <> '' AND len([x FOR x IN contexts IF contains({normal("x")}, {normal("quotes[1]")})]) > 0 END AS citations_valid, n_chars AS latency_ms, CAST(0 AS BIGINT) AS llm_calls
FROM r JOIN labels ON id = doc_id""",
    "A5_agreement": f"""WITH {PAIRED},
k AS (SELECT rank() OVER (ORDER BY ragas) + (count(*) OVER (PARTITION BY ragas) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY deepeval) + (count(*) OVER (PARTITION BY deepeval) - 1) / 2.0e0 AS ry FROM j)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM k""",
    "A5_disagreements": f"WITH {PAIRED} SELECT * FROM j WHERE abs(ragas - deepeval) > 0.3",
    "A6_ratings_by_route": f"WITH {RATINGS}, {LOGS} SELECT coalesce(nullif(route, ''), '(none)') AS key, count(*) AS n, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating >= 4) AS up, count(*) FILTER (rating <= 2) AS down FROM f JOIN l USING (query_id) GROUP BY 1",
    "A6_ratings_by_type": f"""WITH {RATINGS}, {LOGS}, c AS (SELECT query_id, unnest(cited) AS doc_id FROM l),
k AS (SELECT DISTINCT query_id, coalesce(lang, '(unknown)') AS kind FROM c LEFT JOIN documents USING (doc_id))
SELECT kind AS key, count(*) AS n, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating >= 4) AS up, count(*) FILTER (rating <= 2) AS down FROM f JOIN k USING (query_id) GROUP BY kind""",
    "A7_worst_queries": f"WITH {RATINGS}, {LOGS} SELECT query_id, count(*) AS n, round(avg(rating), 6) AS mean_rating, any_value(route) AS route FROM f JOIN l USING (query_id) GROUP BY query_id ORDER BY round(avg(rating), 6), n DESC, query_id LIMIT 20",
    "A10_framework_means": f"WITH {PAIRED} SELECT round(avg(ragas), 6) AS ragas, count(*) AS n_ragas, round(avg(deepeval), 6) AS deepeval, count(*) AS n_deepeval FROM j JOIN labels ON id = doc_id WHERE toxic <> 1",
    "A11_frequencies": "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_lang, count(DISTINCT text) AS n_texts FROM documents GROUP BY source",
    "J9_split_overlap": "SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "J1_joined_sources": r"""WITH p AS (SELECT p_partkey, replace(lower(p_name), ' ', '_') AS stem, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part),
c AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, arg_min(p_name, p_partkey) AS csv FROM part WHERE p_name LIKE 's%' OR p_name LIKE 'r%' GROUP BY 1),
x AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, arg_min(p_name, p_partkey) AS txt FROM part WHERE p_name LIKE '%bolt%' OR p_name LIKE '%ring%' GROUP BY 1)
SELECT p_partkey, csv, txt, nullif(concat_ws('+', CASE WHEN csv IS NULL THEN 'csv' END, CASE WHEN txt IS NULL THEN 'txt' END), '') AS missing FROM p LEFT JOIN c USING (key) LEFT JOIN x USING (key)""",
    "G2_edges": """WITH d AS (SELECT event_id, CAST(floor(value) AS BIGINT) % 4 AS n, event_id % 3 AS r, event_type FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'answer_general' WHEN 'click' THEN 'clarify' WHEN 'error' THEN 'refuse' ELSE 'plan_retrieval' END AS classified,
  CASE WHEN n >= 2 THEN 'generate' WHEN r < 2 THEN 'rewrite_query' WHEN n > 0 THEN 'generate' ELSE 'abstain' END AS after_grade,
  CASE WHEN n > 1 THEN 'finalize' WHEN r < 1 THEN 'regenerate_strict' ELSE 'abstain' END AS after_verify FROM d""",
    "G6_grades": f"WITH {BM25} SELECT query_id, count(*) AS n, count(*) FILTER (score >= 20) AS n_relevant FROM sparse WHERE rank <= 10 GROUP BY query_id",
    "G6_clipped": "SELECT doc_id, md5(CASE WHEN length(text) > 800 THEN substring(text, 1, 797) || '...' ELSE text END) AS text_md5 FROM documents",
    "G7_lexical_support": f"""WITH {TURNS}, z AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last FROM t),
a AS (SELECT doc_id, list_filter(string_split({normal("text")}, ' '), lambda w: length(w) > 2) AS ws FROM z WHERE page_no = last),
c AS (SELECT doc_id, {normal("string_agg(text, ' ' ORDER BY page_no)")} AS hay FROM z WHERE page_no < last GROUP BY doc_id),
s AS (SELECT doc_id AS query_id, round(coalesce(len(list_filter(ws, lambda w: contains(coalesce(hay, ''), w))) / nullif(len(ws), 0), 0), 6) AS score FROM a LEFT JOIN c USING (doc_id))
SELECT *, score >= 0.1 AS grounded FROM s""",
    "G8_citations": f"""WITH {BM25}, r AS (SELECT query_id, chunk_id, rank, b.text AS quote, c.text FROM sparse JOIN benchmark b ON b.item_id = query_id JOIN chunks c USING (chunk_id) WHERE rank <= 3)
SELECT query_id, CASE WHEN rank = 3 THEN chunk_id || '?' ELSE chunk_id END AS chunk_id, CASE WHEN rank = 3 THEN 'unknown chunk_id ' || chunk_id || '?' WHEN rank = 2 THEN 'doc_id mismatch for ' || chunk_id
  WHEN NOT contains({normal("text")}, {normal("quote")}) THEN 'quote not in chunk ' || chunk_id END AS error FROM r""",
    "G9_abstain_text": f"""WITH {BM25}, n AS (SELECT query_id, string_agg(replace(chunk_id, ':', ' p.'), '; ' ORDER BY rank) AS p FROM sparse WHERE rank <= 3 GROUP BY query_id)
SELECT item_id AS query_id, 'The knowledge base does not contain a clause answering this for the requested document.' || coalesce(' Closest passages: ' || p || '.', '') AS text FROM benchmark LEFT JOIN n ON query_id = item_id""",
    "G13_cited_documents": f"WITH {LOGS} SELECT query_id, CASE WHEN query_id = 0 THEN '0,' || cited[3] ELSE array_to_string(cited, ',') END AS cited FROM l",
    "N1_normalised": f"SELECT doc_id, md5({normal('text')}) AS text_md5 FROM documents",
    "N3_fragments": f"""WITH f AS (SELECT item_id, list_filter(list_transform(string_split(text, '. '), lambda p: {normal("p")}), lambda p: p <> '') AS f FROM benchmark)
SELECT item_id, unnest(range(len(f))) AS at, unnest(f) AS fragment FROM f""",
    "N4_stems": rf"""WITH s AS (SELECT page_id, {STEM.format(c="url")} AS stem FROM pages),
f AS (SELECT *, regexp_replace(regexp_replace(stem, '[\s_-]*part\s*[0-9]+$', ''), '\s*\([0-9]+\)$', '') AS f FROM s)
SELECT page_id, stem, regexp_replace(stem, '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(f, '([a-z])[0-9]+$', '\1')) AS family FROM f""",
    "N7_tokens": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL",
    "N8_questions": """WITH n AS (SELECT p_partkey, p_size % 3 AS s, upper(p_name[1]) || lower(string_split(p_name, ' ')[1])[2:] || ' ' || p_type AS d FROM part)
SELECT p_partkey, CASE s WHEN 0 THEN 'Does the ' || d || ' include an Exclusivity clause?' WHEN 1 THEN 'Does the ' || d || ' include an Audit Rights clause?' ELSE 'Which jurisdiction''s law governs the ' || d || '?' END AS question FROM n""",
    "N9_safe_names": r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\.[^.]*$', '\1') AS s, url FROM pages)
SELECT page_id, regexp_replace(substring(regexp_replace(s, '[^A-Za-z0-9_.\- ]+', '', 'g'), 1, 120), '^[ ._]+|[ ._]+$', '', 'g') AS name, trim(regexp_replace(lower(url), '\s+', ' ', 'g')) AS key FROM s""",
    "N10_repaired_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "W1_windowed_counts": "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
}
ORACLE["M4_stratified_quotas"] = """WITH RECURSIVE h AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1),
t AS (SELECT CAST(round_even(0.5e0 * sum(n), 0) AS BIGINT) AS target FROM h),
q AS (SELECT s, n, least(n, CASE WHEN n >= 3 THEN greatest(3, CAST(round_even(0.78e0 * n, 0) AS BIGINT)) ELSE CAST(round_even(0.78e0 * n, 0) AS BIGINT) END) AS k FROM h),
r AS (
  SELECT 0 AS step, s, k FROM q
  UNION ALL
  SELECT step + 1, s, k - CASE WHEN row_number() OVER (ORDER BY k DESC, s DESC) = 1 THEN 1 ELSE 0 END FROM r WHERE (SELECT sum(k) FROM q) - step > (SELECT target FROM t))
SELECT s AS c_mktsegment, k AS n FROM r WHERE step = (SELECT max(step) FROM r)"""
ORACLE["M6_split"] = """WITH l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id), h AS (SELECT quality, count(*) AS n FROM l GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(round_even(0.6e0 * sum(n), 0) AS BIGINT) AS target FROM h)
SELECT quality, CAST(round_even(n * target / total, 0) AS BIGINT) AS n FROM h, t"""

ORACLE["J11_back_filled_grades"] = "SELECT source AS query_id, d.doc_id AS chunk_id, coalesce(quality = 1, false) AS relevant FROM documents d LEFT JOIN labels l USING (doc_id)"
ORACLE["X1_inventory"] = """WITH c AS (
  SELECT doc_id, 'Governing Law' AS category, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'License')) AS spans, lang AS answer FROM documents
  UNION ALL SELECT doc_id, 'Parties', list_filter(string_split(text, chr(10)), lambda x: contains(x, '@')), 'No' FROM documents
  UNION ALL SELECT doc_id, 'Exclusivity', list_filter(string_split(text, chr(10)), lambda x: contains(x, 'token')), '' FROM documents)
SELECT doc_id, 'slot' AS bucket, category, len(spans) AS n_spans, answer FROM c WHERE category = 'Governing Law' AND len(spans) > 0 AND coalesce(answer, '') <> ''
UNION ALL SELECT doc_id, CASE WHEN len(spans) > 0 THEN 'yes_span' ELSE 'no_answer' END, category, len(spans), CASE WHEN len(spans) > 0 THEN 'Yes' END FROM c WHERE category = 'Exclusivity'
UNION ALL SELECT a.doc_id, 'cross_ref', 'Governing Law + Parties', len(a.spans) + len(b.spans), NULL FROM c a JOIN c b USING (doc_id)
WHERE a.category = 'Governing Law' AND b.category = 'Parties' AND len(a.spans) > 0 AND len(b.spans) > 0"""
ORACLE["X3_missing_inputs"] = f"WITH {LOGS} SELECT query_id, NOT n_turns > 2 AS faithfulness, false AS answer_relevancy, NOT (n_turns > 2 AND length(question) > 100) AS contextual_recall FROM l"
ORACLE["X8_chunk_keys"] = "SELECT conv_id, turn, CASE WHEN role = 'user' THEN conv_id || '-' || turn ELSE conv_id || ':' || turn END AS key FROM conversations"
ORACLE["N11_references"] = f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text END AS answer, string_split(text, '. ') AS s FROM conversations),
n AS (SELECT *, {normal("array_to_string(s, ' ')")} AS hay FROM t)
SELECT conv_id, turn, md5(coalesce(nullif(answer, ''), nullif(array_to_string(s, ' '), ''))) AS reference_md5,
  len(list_filter(s, lambda q: trim(q) = '' OR NOT contains(hay, {normal("q")}))) = 0 AS citations_hold FROM n"""
ORACLE["A9_ingest_report"] = f"""WITH {CHUNKS}, k AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
o AS (SELECT d.doc_id, text, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'skipped' WHEN n > 0 THEN 'indexed' ELSE 'failed' END AS status, n FROM documents d LEFT JOIN k USING (doc_id))
SELECT count(*) AS docs, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed,
  CAST(coalesce(sum(length(text)) FILTER (status = 'indexed'), 0) AS BIGINT) AS chars,
  CAST(coalesce(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) FILTER (status = 'indexed'), 0) AS BIGINT) AS est_tokens, CAST(coalesce(sum(n) FILTER (status = 'indexed'), 0) AS BIGINT) AS chunks FROM o"""
ORACLE["C3_packed_chunks"] = r"""WITH RECURSIVE
q AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \n]*[ \n]|[^ \n]+') AS p FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, length(x) AS n, pos FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS pos FROM q)),
c AS (SELECT doc_id, pos, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS z FROM e),
l AS (SELECT doc_id, list(z ORDER BY pos) AS ends, max(z) AS n FROM c GROUP BY doc_id),
r AS (
  SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS a, coalesce(list_max(list_filter(ends, lambda x: x <= 2048)), ends[1]) AS b, n FROM l
  UNION ALL
  SELECT doc_id, k + 1, a, coalesce(list_max(list_filter(ends, lambda x: x > a AND x <= a + 2048)), list_min(list_filter(ends, lambda x: x > a))), n
  FROM (SELECT r.doc_id, k, ends, r.n, greatest(list_min(list_filter(ends, lambda x: x > r.a)), coalesce(list_max(list_filter(ends, lambda x: x <= r.b - 256)), 0)) AS a FROM r JOIN l USING (doc_id) WHERE r.b < r.n))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_idx, a AS "start", b AS "end", md5(substring(text, a + 1, b - a)) AS text_md5
FROM r JOIN q USING (doc_id) WHERE regexp_matches(substring(text, a + 1, b - a), '\S')"""
ORACLE["M5_holdout"] = """WITH a AS (SELECT doc_id, lang FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1),
h AS (SELECT lang, count(*) AS n FROM a GROUP BY lang),
e AS (SELECT least(24, coalesce((SELECT n FROM h WHERE lang = 'en'), 0)) AS en),
f AS (SELECT en, least(40 - en, coalesce((SELECT n FROM h WHERE lang = 'fr'), 0)) AS fr FROM e),
g AS (SELECT en, fr, least(50 - en - fr, coalesce((SELECT n FROM h WHERE lang = 'de'), 0)) AS de FROM f),
b AS (SELECT h.lang, n, CASE h.lang WHEN 'en' THEN en WHEN 'fr' THEN fr WHEN 'de' THEN de ELSE 0 END AS k, 50 - en - fr - de AS short FROM h, g),
w AS (SELECT lang, k + greatest(0, least(n - k, short - coalesce(sum(n - k) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS q FROM b)
SELECT doc_id, lang FROM a JOIN w USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('43:' || doc_id), doc_id) <= q"""
