"""DuckDB SQL for the registered queries. Shared derivations are CTEs put in front."""

from __future__ import annotations

from ..functions import labels
from ..functions.text import STOP_WORDS
from . import fixtures as fx

WS = r"[ \t\n\r\f\x0B]"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def hashed(text: str) -> str:
    """The first 13 hex digits of a text's MD5 as a double."""
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE"


def _learn(rounds: int, last: str) -> str:
    """The learn loop, one round after another, until a mean error is below 0.01."""
    ctes = [
        "x AS MATERIALIZED (SELECT event_id AS i, user_id % 50 AS state, event_id % 4 AS action, event_id % 5 / 4 AS reward, (user_id * 7 + 3) % 50 AS next_state, event_id % 9 = 0 AS done FROM events)",
        "v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY state ORDER BY i) - 1 AS v FROM x)",
        "b AS MATERIALIZED (SELECT *, reward + 0.5::DOUBLE * CASE WHEN v = 0 THEN 1 ELSE 1 / (1 + sqrt(v)) END AS total FROM v ORDER BY i DESC LIMIT 10000)",
        "q0 AS MATERIALIZED (SELECT DISTINCT state, action, (state * 7 + action * 3) % 10 / 10 AS value, 0 AS visits FROM x)",
        "l0 AS MATERIALIZED (SELECT 0 AS round, 0 AS drawn, 1.0::DOUBLE AS error, true AS going)",
    ]
    for r in range(1, rounds + 1):
        u = f"({hashed(f"'{r}|' || i")} + 1) / 4503599627370496.0"
        ctes += [
            f"d{r} AS MATERIALIZED (SELECT b.* FROM b, l{r - 1} WHERE going ORDER BY -ln({u}) / (abs(total) + 0.01::DOUBLE), i LIMIT 32)",
            f"m{r} AS (SELECT state AS next_state, max(value) AS best FROM q{r - 1} GROUP BY 1)",
            f"t{r} AS (SELECT state, action, avg(total + 0.99::DOUBLE * CASE WHEN done THEN 0 ELSE coalesce(best, 0) END) AS target, count(*) AS n FROM d{r} LEFT JOIN m{r} USING (next_state) GROUP BY 1, 2)",
            f"s{r} AS MATERIALIZED (SELECT state, action, coalesce(value, 0) AS old, coalesce(target - coalesce(value, 0), 0) AS error, coalesce(n, 0) AS n, coalesce(visits, 0) AS visits FROM q{r - 1} FULL JOIN t{r} USING (state, action))",
            f"q{r} AS MATERIALIZED (SELECT state, action, old + 0.1::DOUBLE * error AS value, visits + n AS visits FROM s{r})",
            f"l{r} AS MATERIALIZED (SELECT {r} AS round, sum(n) AS drawn, sum(n * error) / sum(n) AS error, coalesce(abs(sum(n * error) / sum(n)) >= 0.01::DOUBLE, false) AS going FROM s{r})",
        ]
    return "WITH " + ", ".join(ctes) + " " + last


def _bank(batches: int, k: int = 100) -> str:
    """Centres from the first vectors by hash, one pass over all, then batches."""
    near = lambda rows, c: f"SELECT t.vec_id, t.vector, t.importance, c.centre FROM {rows} t, {c} c QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.vector, c.vector), c.centre) = 1"
    total = lambda a: f"SELECT centre, list(x ORDER BY i) AS s, any_value(n) AS n, any_value(qw) AS qw FROM (SELECT centre, i, sum(vector[i]) AS x, count(*) AS n, sum(importance) AS qw FROM {a}, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1"
    ctes = [
        "p AS (SELECT *, 0.0::DOUBLE AS weight FROM memories)",
        f"f AS (SELECT vector, min({{'h': {hashed('id')}, 'id': id}}) AS o FROM memories GROUP BY 1)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS centre, vector FROM f QUALIFY row_number() OVER (ORDER BY o) <= {k})",
        f"a0 AS MATERIALIZED ({near('memories', 'c0')})", f"u0 AS MATERIALIZED ({total('a0')})",
        "k0 AS MATERIALIZED (SELECT centre, coalesce(list_transform(s, lambda y: y / n), vector) AS vector, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS quality, 0 AS size FROM c0 LEFT JOIN u0 USING (centre))",
    ]
    for b in range(1, batches + 1):
        ctes += [
            f"w{b} AS (SELECT * FROM memories WHERE vec_id % {batches} = {b - 1})", f"a{b} AS MATERIALIZED ({near(f'w{b}', f'k{b - 1}')})", f"u{b} AS MATERIALIZED ({total(f'a{b}')})",
            f"""k{b} AS MATERIALIZED (SELECT centre, CASE WHEN n IS NULL THEN vector ELSE list_transform(range(1, 65), lambda i: (vector[i] * weight * 0.9::DOUBLE + s[i]) / (weight * 0.9::DOUBLE + n)) END AS vector,
  CASE WHEN n IS NULL THEN weight ELSE weight * 0.9::DOUBLE + n END AS weight, CASE WHEN n IS NULL THEN quality ELSE (quality * weight * 0.9::DOUBLE + qw) / (weight * 0.9::DOUBLE + n) END AS quality, size + coalesce(n, 0) AS size
  FROM k{b - 1} LEFT JOIN u{b} USING (centre))""",
        ]
    return _with(MEM, *ctes) + f"SELECT 'pattern-' || centre AS id, round(quality, 6) AS quality, size, list_transform(vector, lambda y: round(y, 6)) AS vector FROM k{batches} WHERE size > 0 AND quality >= 0.3"


MEM = f"""memories AS (SELECT 'mem-' || vec_id AS id, vec_id, CAST(embedding AS DOUBLE[]) AS vector, {_list(labels.MEMORY_TYPES)}[(vec_id % 8) + 1] AS memory_type,
  (vec_id * 37 % 100) / 100 AS importance, (vec_id * 53 % 120) / 100 AS decay, vec_id * 7 % 23 AS access_count, {fx.T0} + vec_id * 60000 AS timestamp FROM embeddings)"""
Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
FILES = f"""files AS (SELECT '/data/' || source || '/doc_' || doc_id || '.' || ext AS path, 'doc_' || doc_id || '.' || ext AS name, * FROM (
  SELECT {_list(fx.EXTENSIONS)}[(doc_id % 6) + 1] AS ext, {fx.T0 // 1000} + doc_id * 3600 AS modified, doc_id, source, text, strlen(text) AS size FROM documents))"""


def _words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda w: w <> '')"


def _chunked(name: str, src: str, keys: str, body: str, size: int, overlap: int) -> str:
    step = max(size - overlap, 1)
    return f"""{name}_w AS (SELECT {keys}, {_words(body)} AS w FROM {src}),
{name} AS (SELECT {keys}, k AS chunk_index, array_to_string(w[k * {step} + 1 : k * {step} + {size}], ' ') AS content FROM (
  SELECT *, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {size} THEN [0] ELSE range(0, CAST(floor((len(w) - {overlap // 2} - 1) / {step}) AS BIGINT) + 1) END) AS k FROM {name}_w))"""


CHUNKS = FILES + ",\n" + _chunked("chunks", "files", "path, doc_id", "'[' || path || ']' || chr(10) || text", 512, 128)
CHUNK_VECTORS = CHUNKS + """,
cv AS (SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS vector FROM chunks c JOIN embeddings e ON e.vec_id = (c.doc_id * 31 + c.chunk_index) % (SELECT count(*) FROM embeddings))"""
MAIL = f"""mail AS (SELECT doc_id AS message_id, {_list(fx.SENDERS)}[(doc_id % 7) + 1] AS sender,
  array_to_string(({_words('text')})[1:6], ' ') || CASE WHEN doc_id % 5 = 0 THEN ' weekly digest' ELSE '' END AS subject,
  text || CASE WHEN doc_id % 4 = 0 THEN ' unsubscribe' ELSE '' END AS body, {_list(fx.MAILBOXES)}[(doc_id % 6) + 1] AS mailbox, {fx.T0 // 1000} + doc_id * 60 AS indexed_at
  FROM documents WHERE doc_id % 3 = 0)"""
ACT = """act0 AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS timestamp, event_type AS app_name, 'file' || json_extract_string(props, '$.k') || '.py — proj' || (user_id % 10) AS window_title, user_id, value, ts FROM events),
act AS (SELECT *, nullif(regexp_extract(trim(string_split(window_title, ' — ')[-1]), '^[^\\[\\( ]*'), '') AS project FROM act0)"""
HIST = """hist AS (SELECT p.page_id, url, count(*) AS visit_count, (CAST(floor(epoch(max(ts))) AS BIGINT) + 11644473600) * 1000000 AS last_visit_time
  FROM pages p JOIN events e ON e.event_id % (SELECT count(*) FROM pages) = p.page_id GROUP BY p.page_id, url)"""
EDGES = """pairs AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.vector, b.vector) AS similarity FROM memories a JOIN memories b ON a.id <> b.id),
edges AS (SELECT * FROM pairs WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 5),
ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
HYPER = """hyper AS (SELECT src, [src] || list(dst ORDER BY similarity DESC, dst)[1:4] AS members, 0.6 AS confidence FROM edges GROUP BY src HAVING count(*) >= 2)"""

LOG = f"""shown AS (SELECT src, list(dst ORDER BY similarity DESC, dst) AS r FROM edges GROUP BY src),
log AS (SELECT r, r[(CAST(substr(src, 5) AS BIGINT) % len(r)) + 1] AS selected FROM shown),
shown_pairs AS (SELECT selected, other FROM (SELECT selected, unnest(r) AS other FROM log) WHERE other <> selected),
f AS (SELECT id, vector, ln(1 + access_count) / 10 AS fa, exp((timestamp - {fx.AS_OF}) / 86400000) AS fr, CASE WHEN memory_type = 'Semantic' THEN 1.0 ELSE 0.0 END::DOUBLE AS ft FROM memories),
pairs_of AS (SELECT p.selected, p.other, s.vector AS q, o.vector AS v, s.fa AS sa, s.fr AS sr, s.ft AS st, o.fa AS oa, o.fr AS ors, o.ft AS ot FROM shown_pairs p JOIN f s ON s.id = p.selected JOIN f o ON o.id = p.other)"""
#: One step of the network with four hidden units: its outputs for both of a pair, which pairs lose, and the sums of their gradients.
STEP = """cols AS (SELECT h, list_transform(range(128), lambda j: 0.1 * sin(1 + j * 4 + h)) AS w FROM range(4) AS t(h)),
numbered AS (SELECT row_number() OVER () AS p, * FROM pairs_of),
hid AS (SELECT p, h, greatest(0, list_dot_product(q || q, w)) AS a, greatest(0, list_dot_product(q || v, w)) AS b FROM numbered, cols),
outs AS (SELECT p, sum(0.1 * sin(1 + h) * a) AS oa, sum(0.1 * sin(1 + h) * b) AS ob FROM hid GROUP BY p),
feats AS (SELECT p, 4 + k AS h, [1.0, sa, sr, st][k + 1] AS a, [0.5, oa, ors, ot][k + 1] AS b FROM numbered, range(4) AS t(k)),
fouts AS (SELECT p, sum(0.1 * sin(1 + h) * a) AS oa, sum(0.1 * sin(1 + h) * b) AS ob FROM feats GROUP BY p),
active AS (SELECT p FROM outs JOIN fouts USING (p) WHERE 0.1 - (outs.oa + fouts.oa) + (outs.ob + fouts.ob) > 0),
total AS (SELECT count(*) AS n FROM pairs_of),
g2 AS (SELECT h, sum(CASE WHEN p IN (FROM active) THEN b - a ELSE 0 END) AS g FROM (FROM hid UNION ALL FROM feats) GROUP BY h),
gb AS (SELECT h, sum(CASE WHEN p IN (FROM active) THEN 0.1 * sin(1 + h) * ((b > 0)::INT - (a > 0)::INT) ELSE 0 END) AS g FROM hid GROUP BY h),
g1 AS (SELECT j, h, sum(CASE WHEN p IN (FROM active) THEN 0.1 * sin(1 + h) * ((b > 0)::INT * (q || v)[j + 1] - (a > 0)::INT * (q || q)[j + 1]) ELSE 0 END) AS g FROM hid JOIN numbered USING (p), range(128) AS t(j) GROUP BY j, h)"""


def _hashed(name: str, src: str, key: str, body: str, dim: int) -> str:
    """The embedding without a model in SQL: `name` has the key and v, a normalised vector. CRC-32 is folded over the bytes of each distinct word or pair."""
    return f"""{name}_t AS (SELECT {key}, list_transform(string_split(lower({body}), ''), lambda c: unicode(c)) AS c, {_words(f"lower({body})")} AS w FROM {src} WHERE {body} IS NOT NULL),
{name}_3 AS (SELECT {key}, c[i] AS x, c[i + 1] AS y, c[i + 2] AS z, count(*) AS n FROM (SELECT {key}, c, unnest(range(1, len(c) - 1)) AS i FROM {name}_t) GROUP BY ALL),
{name}_m AS (SELECT {key}, n, CAST((x::UHUGEINT * 11400714819323198485::UHUGEINT + y::UHUGEINT * 14029467366897019727::UHUGEINT + z::UHUGEINT * 1609587929392839161::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS m FROM {name}_3),
{name}_k AS (SELECT {key}, n, CAST((CAST(xor(m, m >> 29) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS m FROM {name}_m),
{name}_w AS (SELECT {key}, w, count(*) AS n, 0 AS pair FROM (SELECT {key}, unnest(w) AS w FROM {name}_t) GROUP BY ALL UNION ALL
  SELECT {key}, w, count(*), 1 FROM (SELECT {key}, w[i] || ' ' || w[i + 1] AS w FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM {name}_t)) GROUP BY ALL),
{name}_h AS (SELECT w, xor(list_reduce(list_transform(range(CAST(len(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, i * 2 + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT DISTINCT w, hex(encode(w)) AS x FROM {name}_w), (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k)) AS t)),
{name}_s AS (SELECT {key}, CAST((m >> 16) % {dim} AS BIGINT) AS s, n AS weight FROM {name}_k UNION ALL SELECT {key}, h % {dim}, n * CASE pair WHEN 1 THEN 1.5 ELSE 2 END FROM {name}_w JOIN {name}_h USING (w)
  UNION ALL SELECT {key}, (h >> 16) % {dim}, n FROM {name}_w JOIN {name}_h USING (w) WHERE pair = 0),
{name}_v AS (SELECT {key}, map(list(s), list(weight)) AS p, sqrt(sum(weight * weight)) AS size FROM (SELECT {key}, s, CAST(sum(weight) AS DOUBLE) AS weight FROM {name}_s GROUP BY ALL) GROUP BY {key}),
{name} AS (SELECT {key}, list_transform(range({dim}), lambda j: coalesce(p[j], 0.0) / coalesce(size, 1.0)) AS v FROM {name}_t LEFT JOIN {name}_v USING ({key}))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


SIM = {
    "cosine": "list_cosine_similarity(vector, q)",
    "dot": "list_dot_product(vector, q)",
    "euclidean": "1 / (1 + list_distance(vector, q))",
    "manhattan": "1 / (1 + list_sum(list_transform(range(1, 65), lambda i: abs(vector[i] - q[i]))))",
}


def _recalled(k=10, least=0.05, where="true", metric="cosine") -> str:
    return f"""hits AS (SELECT *, {SIM[metric]} * greatest(1 - decay, 0.5) AS similarity FROM memories, q WHERE {where} AND {SIM[metric]} * greatest(1 - decay, 0.5) >= {least}
  ORDER BY similarity DESC, id LIMIT {k})"""


def _recall(**how) -> str:
    return _with(MEM, Q, _recalled(**how)) + "SELECT id, memory_type, round(similarity, 6) AS similarity FROM hits"


STATE = "id, memory_type, round({i}, 6) AS importance, round({d}, 6) AS decay, {a} AS access_count, timestamp"


def _state(i="importance", d="decay", a="access_count") -> str:
    return STATE.format(i=i, d=d, a=a)


FILE_HITS = f"""filehits AS (SELECT f.path, f.name, f.ext, c.chunk_index, c.doc_id, c.content,
    CASE WHEN f.ext IN {_in(labels.BOOSTED)} THEN s * 1.15 WHEN f.ext IN {_in(labels.LOWERED)} THEN s * 0.95 ELSE s END AS similarity
  FROM (SELECT *, list_cosine_similarity(vector, q) AS s FROM cv, q) c JOIN files f USING (path) WHERE s > 0.2 ORDER BY similarity DESC, path, chunk_index LIMIT 20)"""
MERGED = """merged AS (SELECT path, name, ext, string_agg(content, chr(10) || chr(10) ORDER BY r) AS content, max(similarity) AS similarity, min(r) AS rank
  FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, path, chunk_index) AS r FROM filehits) GROUP BY ALL)"""
PREVIEW = "CASE WHEN strlen({t}) > 200 THEN substr({t}, 1, least(199, length({t}) - 1)) ELSE {t} END"


def _preview(t: str) -> str:
    return PREVIEW.format(t=f"replace(replace({t}, chr(10), ' '), chr(13), '')")


def _cut(t: str, n: str) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} WHEN contains(substr({t}, 1, {n}), ' ') THEN regexp_replace(substr({t}, 1, {n}), ' [^ ]*$', '') ELSE substr({t}, 1, {n}) END"


def _any(t: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({t}, '{p}')" for p in patterns) + ")"


NEWS = f"""CASE WHEN {_any('lower(sender)', labels.SENDER_STRONG)} THEN 3 WHEN {_any('lower(sender)', labels.SENDER_MEDIUM)} THEN 2 WHEN {_any('lower(sender)', labels.SENDER_WEAK)} THEN 1 ELSE 0 END
  + CASE WHEN {_any('lower(subject)', labels.SUBJECTS)} THEN 2 ELSE 0 END + CASE WHEN {_any('lower(body)', ('unsubscribe', 'abmelden'))} THEN 2 ELSE 0 END
  + CASE WHEN {_any('lower(body)', ('view in browser', 'im browser anzeigen'))} THEN 2 ELSE 0 END + CASE WHEN {_any('lower(body)', ('manage preferences', 'opt out', 'email preferences'))} THEN 1 ELSE 0 END"""
SENDER = "CASE WHEN contains(sender, '<') THEN nullif(trim(trim(trim(string_split(sender, '<')[1]), '\"')), '') END"
CLEAN = "array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$', '', 'g')), lambda x: x <> ''), chr(10))"
NONBLANK = "array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^" + WS + "+|" + WS + "+$', '', 'g')), lambda x: x <> ''), chr(10))"


def _kind(ext: str) -> str:
    return "CASE " + " ".join(f"WHEN {ext} IN {_in(v.split())} THEN '{k}'" for k, v in labels.KINDS.items()) + " ELSE 'file' END"


def _type(name: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({name}) IN {_in([k.lower(), *labels.TYPE_ALIASES[k].split()])} THEN '{k}'" for k in labels.MEMORY_TYPES) + " ELSE 'Semantic' END"


def _context(field: int) -> str:
    found = [(p, v[field]) for p, v in labels.CONTEXTS.items() if v[field]]
    return "CASE " + " ".join(f"WHEN starts_with(id, '{p}') THEN '{v}'" for p, v in found) + " END"


PROJECTS = """marked AS (SELECT DISTINCT '/data/' || source AS root, source AS project FROM documents WHERE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 = 0)"""
MARKER_MAIL = "'From: ' || sender || chr(10) || 'Subject: ' || subject"

FUSED = (
    CHUNK_VECTORS, Q, FILE_HITS,
    "sc AS (SELECT *, list_cosine_similarity(vector, q) AS s FROM cv, q)",
    """hits AS (SELECT * FROM (SELECT 'email' AS source, doc_id || '/' || chunk_index AS id, content, s AS similarity FROM sc WHERE doc_id % 3 = 0 ORDER BY s DESC, doc_id, chunk_index LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'file', doc_id || '/' || chunk_index, content, similarity FROM filehits ORDER BY similarity DESC, path, chunk_index LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'system', doc_id || '/' || chunk_index, content, 0.0 FROM cv WHERE contains(lower(content), 'the and') ORDER BY doc_id, chunk_index LIMIT 8))""",
    """w AS (SELECT *, sum(similarity) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM hits)""",
    """b AS (SELECT source, id, content, CAST(floor(CASE source WHEN 'email' THEN 8000 / n WHEN 'file' THEN greatest(10000 * CASE WHEN total > 0 THEN similarity / total ELSE 1 / n END, 200.0) ELSE 2000 / n END) AS BIGINT) AS chars FROM w)""",
)


ORACLES: dict[str, str] = {
    "recall_topk": _recall(),
    "recall_typed": _recall(k=5, where="lower(memory_type) IN ('semantic', 'goal')"),
    "recall_euclidean": _recall(metric="euclidean"),
    "recall_manhattan": _recall(metric="manhattan"),
    "recall_dot": _recall(metric="dot", least=0.2),
    "normalize_vectors": _with(MEM, "t AS (SELECT id, list_transform(vector, lambda x: x * 3) AS v FROM memories)") + "SELECT id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS unit FROM t",
    "softmax_vectors": _with(MEM, "t AS (SELECT id, list_transform(vector, lambda x: exp(x - list_max(vector))) AS e FROM memories)") + "SELECT id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS weights FROM t",
    "fitted_vectors": _with(MEM) + "SELECT id, vector[1:60] || [0.0::DOUBLE, 0, 0, 0] AS padded, vector[1:16] AS cut FROM memories",
    "state_hashes": _with(MEM) + "SELECT id, substr(md5(array_to_string(list_transform(vector, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',')), 1, 16) AS state FROM memories",
    "vector_codec": "SELECT vec_id, CAST(len(embedding) * 4 AS BIGINT) AS bytes, embedding AS vector FROM embeddings",
    "chunk_documents": "WITH " + _chunked("c", "documents", "doc_id", "text", 512, 128) + " SELECT doc_id, chunk_index, content AS chunk FROM c",
    "clean_texts": "SELECT doc_id, " + CLEAN.format(t="' ' || chr(9) || replace(text, '. ', ' . ' || chr(10) || chr(10))") + " AS clean FROM documents",
    "strip_markup_compat": "SELECT page_id, CASE WHEN regexp_matches(lower(html), '^[^<]*<(script|style)') THEN replace(string_split(html, '<')[1], '>', '') ELSE replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') END AS plain FROM pages",
    "strip_markup": "SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>', '', 'g'), '<[^>]*(>|$)', '', 'g') AS plain FROM pages",
    "email_headers": _with(MAIL) + f"SELECT message_id, {MARKER_MAIL} || chr(10) || 'Date: today' || CASE WHEN b = '' THEN '' ELSE chr(10) || b END AS plain FROM (SELECT *, {NONBLANK.format(t='body')} AS b FROM mail)",
    "mime_bodies": _with(MAIL) + f"SELECT message_id, {MARKER_MAIL} || CASE WHEN b = '' THEN '' ELSE chr(10) || b END AS plain FROM (SELECT *, {NONBLANK.format(t='body')} AS b FROM mail)",
    "stored_mail": _with(MAIL) + f"SELECT message_id, {MARKER_MAIL} || chr(10) || 'Date: today' || CASE WHEN b = '' THEN '' ELSE chr(10) || b END AS plain FROM (SELECT *, {NONBLANK.format(t='body')} AS b FROM mail)",
    "concepts": f"""SELECT doc_id, list_filter(list_transform({_words('text')}, lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))),
  lambda w: strlen(w) > 2 AND NOT list_contains({_list(STOP_WORDS)}, w))[1:5] AS concepts FROM documents""",
    "gist": "SELECT doc_id, CASE WHEN length(g) > 200 THEN substr(g, 1, 197) || '...' ELSE g END AS gist FROM (SELECT doc_id, string_split_regex(text, '[.!?]')[1] AS g FROM documents)",
    "kind_by_ext": _with(FILES) + f"SELECT path, {_kind('ext')} AS kind, CASE WHEN ext IN ('pdf', 'docx', 'xlsx', 'xls') THEN 0.55 ELSE 0.45 END::DOUBLE AS importance FROM files",
    "type_alias": f"SELECT event_id, {_type('n')} AS memory_type FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'HowTo' WHEN 1 THEN 'about-me' ELSE event_type END AS n FROM events)",
    "admitted_files": _with(FILES) + "SELECT path, size FROM files WHERE doc_id % 5 > 2 AND size * CASE WHEN doc_id % 7 = 0 THEN 1000 ELSE 1 END <= 1048576",
    "previews": f"SELECT doc_id, {_preview('text')} AS preview, {_cut('text', '120')} AS cut FROM documents",
    "note_frontmatter": f"SELECT doc_id, ['alpha', 'beta', 'gamma'] AS tags, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS body FROM documents",
    "id_contexts": f"""WITH m AS (SELECT vec_id, {_list([*labels.CONTEXTS, 'mem-'])}[(vec_id % 10) + 1] || vec_id AS id FROM embeddings)
SELECT vec_id, {_context(0)} AS who, {_context(1)} AS topic, {_context(2)} AS project, CASE WHEN starts_with(id, 'mem-') THEN ['source:direct'] ELSE CAST([] AS VARCHAR[]) END AS tags FROM m""",
    "safe_queries": "SELECT page_id, url || '\\\"\\\\' AS q, NOT (contains(url, '..') OR contains(url, '/') OR contains(url, '\\')) AS slug, 'last_visit_time' AS snake, substr(md5(url), 1, 16) AS stable FROM pages",
    "file_search": _with(CHUNK_VECTORS, Q, FILE_HITS) + "SELECT path, chunk_index, ext, round(similarity, 6) AS similarity FROM filehits",
    "file_search_merged": _with(CHUNK_VECTORS, Q, FILE_HITS, MERGED) + "SELECT path, name, md5(content) AS content, round(similarity, 6) AS similarity, rank FROM merged",
    "list_files": _with(FILES) + "SELECT path, modified, size FROM files ORDER BY modified DESC, path LIMIT 50 OFFSET 10",
    "folder_files": _with(FILES) + "SELECT path, name FROM files WHERE starts_with(path, '/data/src1/')",
    "file_chunks": _with(CHUNKS) + "SELECT path AS file_path, chunk_index, md5(content) AS content FROM chunks",
    "index_stats": _with(CHUNKS) + "SELECT (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(size) AS BIGINT) FROM files) AS bytes, (SELECT count(*) FROM chunks) AS chunks",
    "projects": _with(CHUNKS, PROJECTS) + "SELECT project, count(DISTINCT f.path) AS files, count(c.chunk_index) AS chunks, min(root) AS root FROM files f JOIN marked m ON m.project = f.source LEFT JOIN chunks c ON c.path = f.path GROUP BY project",
    "projects_with_activity": _with(FILES, PROJECTS, ACT, "a AS (SELECT project, max(timestamp) AS last_active FROM act WHERE project IS NOT NULL GROUP BY 1), o AS (SELECT m.project, count(*) AS files FROM files f JOIN marked m ON m.project = f.source GROUP BY 1)")
    + "SELECT coalesce(a.project, o.project) AS project, last_active, coalesce(files, 0) AS files FROM a FULL JOIN o ON a.project = o.project",
    "doc_reassembly": _with(
        CHUNKS,
        f"whole AS (SELECT path, ext, modified, array_to_string(({_words('b')})[1:4000], ' ') AS body FROM (SELECT f.path, f.ext, f.modified, string_agg(c.content, ' ' ORDER BY c.chunk_index) AS b FROM files f JOIN chunks c USING (path) WHERE f.ext IN ('md', 'pdf', 'csv') GROUP BY ALL))",
        _chunked("again", "whole", "path, ext, modified", "body", 512, 128),
    ) + "SELECT 'bootstrap::file::' || substr(md5(path), 1, 16) || '::' || chunk_index AS id, md5(content) AS content, round(CASE WHEN ext = 'pdf' THEN 0.55 ELSE 0.45 END::DOUBLE, 6) AS importance, modified * 1000 AS timestamp FROM again WHERE chunk_index < 5",
    "enriched_hits": _with(CHUNK_VECTORS, Q, FILE_HITS, MERGED) + "SELECT m.path, rank, size, len(string_split(text, chr(10))) AS lines, md5(array_to_string(string_split(text, chr(10))[1:5], chr(10))) AS head FROM merged m JOIN files f USING (path)",
    "folders": "SELECT source AS name, count(*) AS files FROM documents GROUP BY 1",
    "content_search": _with(CHUNKS) + f"SELECT needle, path, count(*) AS chunks FROM chunks, (SELECT unnest({_list(fx.NEEDLES)}) AS needle) WHERE contains(lower(content), needle) GROUP BY needle, path",
    "content_search_words": _with(CHUNKS) + "SELECT doc_id, chunk_index FROM chunks WHERE contains(' ' || lower(content) || ' ', ' of the ')",
    "mail_anywhere": _with(MAIL, "f AS (SELECT 'sender' AS field, sender AS t FROM mail UNION ALL SELECT 'subject', subject FROM mail UNION ALL SELECT 'body', body FROM mail)")
    + f"SELECT needle, field, count(*) AS mails FROM f, (SELECT unnest({_list((*fx.NEEDLES, 'weekly digest', 'unsub'))}) AS needle) WHERE contains(array_to_string({_words('lower(t)')}, ' '), needle) GROUP BY needle, field",
    "knn_descent": _with(MEM, EDGES) + "SELECT count(*) AS edges, true AS nine_in_ten FROM edges",
    "ivf_recall": _with(MEM, "live AS (SELECT id, vec_id, CASE WHEN vec_id % 15 = 0 THEN list_reverse(vector) ELSE vector END AS v FROM memories WHERE vec_id % 17 <> 3)")
    + """SELECT a.id AS query, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, true AS nine_in_ten FROM live a, live b WHERE a.vec_id % 10 = 0
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) = 1""",
    "changed_files": _with(FILES) + "SELECT path, modified FROM files WHERE doc_id % 4 = 0 OR ext = 'log'",
    "transcripts": "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || chr(10) || chr(10), '' ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id",
    "jsonl_transcripts": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || chr(10) || chr(10) AS line FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''",
    "conversation_segments": _with(
        "t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || chr(10) || chr(10), '' ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '' GROUP BY conv_id), t2 AS (SELECT * FROM t WHERE strlen(transcript) >= 50)",
        _chunked("c", "t2", "conv_id", "transcript", 400, 50),
    ) + "SELECT conv_id, chunk_index, md5(content) AS chunk FROM c WHERE chunk_index < 10",
    "chat_summary": """WITH s AS (SELECT conv_id, turn, substr(text, 1, 80) AS snippet, strlen(text) AS len FROM conversations WHERE coalesce(text, '') <> ''),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, lower(snippet) ORDER BY len DESC, turn) = 1),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY len DESC, turn) <= 8),
t AS (SELECT conv_id, string_agg(snippet, '; ' ORDER BY len DESC, turn) AS topics FROM b GROUP BY conv_id)
SELECT c.conv_id, messages, topics FROM (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1) c LEFT JOIN t USING (conv_id)""",
    "chat_memories": """WITH m AS (SELECT user_id % 50 AS chat, ts, 'a message about the ' || event_type AS text FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY chat) AS n FROM m WHERE length(text) > 20)
SELECT chat, CASE WHEN n <= 100 THEN 'all' ELSE strftime(ts, '%Y-%m') END AS period, count(*) AS messages, min(ts) AS first, max(ts) AS last FROM n GROUP BY 1, 2""",
    "prompt_batches": """WITH r AS (SELECT conv_id % 4 AS g, conv_id, turn, text, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS n FROM conversations WHERE role = 'user' AND length(text) > 20)
SELECT g, CAST(floor((n - 1) / 10) AS BIGINT) AS batch, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY n)) AS content, count(*) AS items FROM r GROUP BY 1, 2""",
    "newsletter_score": _with(MAIL) + f"SELECT message_id, CAST({NEWS} AS BIGINT) AS score FROM mail",
    "mail_ingest_filter": _with(MAIL) + f"SELECT message_id, mailbox FROM mail WHERE {NEWS} < 3 AND lower(mailbox) NOT IN {_in([m.lower() for m in labels.SKIPPED_MAILBOXES])} AND regexp_replace(body, '{WS}', '', 'g') <> ''",
    "mail_search": _with(CHUNK_VECTORS, Q, MAIL) + f"SELECT message_id, chunk_index, {SENDER} AS sender, {_preview('content')} AS preview, round(s, 6) AS similarity FROM (SELECT m.*, c.*, list_cosine_similarity(vector, q) AS s FROM cv c JOIN mail m ON m.message_id = c.doc_id, q) WHERE s > 0.15 ORDER BY s DESC, doc_id, chunk_index LIMIT 15",
    "recent_mail": _with(CHUNKS, MAIL) + f"SELECT message_id, subject, indexed_at, {_preview('p')} AS preview FROM (SELECT m.*, coalesce(c.content, '') AS p FROM mail m LEFT JOIN chunks c ON c.doc_id = m.message_id AND c.chunk_index = 0) ORDER BY indexed_at DESC, message_id LIMIT 30",
    "mail_by_field": _with(MAIL) + f"SELECT message_id, subject, {SENDER} AS sender FROM mail WHERE contains(lower(sender), 'example') AND contains(lower(subject), 'the') ORDER BY message_id LIMIT 25",
    "consolidate": _with(MEM) + f"SELECT {_state(d='decay + 0.01')} FROM memories WHERE NOT (decay > 0.9 AND importance < 0.3)",
    "evict": _with(MEM, "n AS (SELECT count(*) AS n FROM memories), r AS (SELECT *, row_number() OVER (ORDER BY importance * (1 - decay), id) AS r FROM memories)") + f"SELECT {_state()} FROM r, n WHERE n <= 400 OR r > n - 400 + 40",
    "apply_access": _with(MEM, Q, _recalled(), "h AS (SELECT id AS hit FROM hits)") + f"SELECT {_state(d='CASE WHEN hit IS NULL THEN decay ELSE 0 END', a='access_count + CASE WHEN hit IS NULL THEN 0 ELSE 1 END')} FROM memories LEFT JOIN h ON hit = id",
    "merge_update": _with(MEM) + "SELECT id, CASE WHEN vec_id % 6 = 0 THEN 'Goal' ELSE memory_type END AS memory_type, round(CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE importance END, 6) AS importance, round(decay, 6) AS decay, access_count, timestamp FROM memories",
    "store_new": _with(MEM) + f"SELECT {_state()} FROM memories UNION ALL SELECT 'new-' || vec_id, memory_type, round(importance, 6), round(decay, 6), access_count, timestamp FROM memories WHERE vec_id % 10 = 0 AND vec_id % 20 <> 0",
    "connect_memories": """WITH l AS (SELECT 'mem-' || vec_id AS a, 'mem-' || (vec_id // 2) AS b FROM embeddings WHERE vec_id > 0), e AS (SELECT a AS id, b AS o FROM l UNION SELECT b, a FROM l)
SELECT 'mem-' || vec_id AS id, coalesce((SELECT list(o ORDER BY o) FROM e WHERE e.id = 'mem-' || vec_id), CAST([] AS VARCHAR[])) AS connections FROM embeddings""",
    "memory_stats": _with(MEM) + "SELECT count(*) AS n, round(coalesce(avg(importance), 0), 6) AS avg_importance, round(coalesce(avg(decay), 0), 6) AS avg_decay, CAST(coalesce(sum(access_count), 0) AS BIGINT) AS accesses FROM memories",
    "compression_scan": _with(MEM, "t AS (SELECT access_count / (SELECT greatest(sum(access_count), 1) FROM memories) AS s FROM memories)")
    + "SELECT count(*) FILTER (WHERE s > 0.8) AS hot, count(*) FILTER (WHERE s > 0.4 AND s <= 0.8) AS warm, count(*) FILTER (WHERE s <= 0.4) AS cold, round((count(*) FILTER (WHERE s > 0.4 AND s <= 0.8) * 50 + count(*) FILTER (WHERE s <= 0.4) * 75) / greatest(count(*), 1), 1) AS savings_percent FROM t",
    "unbridged": _with(MEM) + "SELECT id, timestamp FROM memories WHERE vec_id % 3 <> 0 ORDER BY timestamp, id LIMIT 40",
    "list_memories": _with(MEM) + "SELECT id, timestamp FROM memories WHERE memory_type = 'Semantic' ORDER BY timestamp DESC, id LIMIT 20 OFFSET 5",
    "goal_progress": _with(MEM) + "SELECT id, round(least((vec_id % 13) / 10, 1.0), 6) AS progress, CASE WHEN (vec_id % 13) >= 10 THEN 'Completed' WHEN vec_id % 13 > 0 THEN 'Active' ELSE 'Pending' END AS status FROM memories WHERE memory_type = 'Goal'",
    "versioned_store": _with(MEM) + "SELECT id, memory_type, round(CASE WHEN vec_id % 4 = 0 THEN 1.0 ELSE importance END, 6) AS importance FROM memories WHERE vec_id % 7 <> 0",
    "migration_report": "SELECT CASE WHEN vec_id % 2 = 0 THEN 'email' ELSE 'file' END AS source, count(*) FILTER (WHERE vec_id % 9 <> 0) AS migrated, count(*) FILTER (WHERE vec_id % 9 = 0) AS skipped FROM embeddings GROUP BY 1",
    "knn_edges": _with(MEM, EDGES) + "SELECT src, dst, round(similarity, 6) AS similarity FROM edges",
    "hyperedges": _with(MEM, EDGES, HYPER) + "SELECT src, members, CAST(confidence AS DOUBLE) AS confidence FROM hyper",
    "k_hop": "WITH RECURSIVE " + ",\n".join([MEM, EDGES, "walk AS (SELECT 'mem-0' AS id, 0 AS hop UNION SELECT dst, hop + 1 FROM walk JOIN ways ON src = id WHERE hop < 2)"]) + " SELECT id, CAST(min(hop) AS BIGINT) AS hop FROM walk GROUP BY id HAVING min(hop) > 0",
    "degree": _with(MEM, EDGES) + "SELECT src AS id, count(*) AS degree FROM ways GROUP BY 1",
    "graph_stats": _with(MEM, EDGES, HYPER) + "SELECT (SELECT count(*) FROM memories) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) // 2 FROM ways) AS pairs, (SELECT count(*) FROM hyper) AS hyperedges",
    "graph_augmented_recall": _with(MEM, Q, EDGES, _recalled(k=5), "best AS (SELECT id FROM hits ORDER BY similarity DESC, id LIMIT 3)")
    + "SELECT id, round(similarity, 6) AS similarity FROM hits UNION ALL SELECT DISTINCT dst, 0.4 FROM best JOIN ways ON src = id WHERE dst NOT IN (SELECT id FROM hits)",
    "graph_view": _with(MEM) + "SELECT id, memory_type, timestamp FROM memories QUALIFY row_number() OVER (PARTITION BY memory_type ORDER BY timestamp DESC, id) <= 25",
    "activity_changes": _with(ACT) + """SELECT id, user_id, app_name, window_title FROM act WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, id)
QUALIFY row_number() OVER w = 1 OR lag(app_name) OVER w IS DISTINCT FROM app_name OR lag(window_title) OVER w IS DISTINCT FROM window_title""",
    "activity_stream": _with(ACT) + "SELECT id, timestamp, app_name, project FROM act WHERE app_name IN ('click', 'error') AND project = 'proj3' ORDER BY timestamp DESC, id LIMIT 100",
    "masked_activity": _with(ACT) + "SELECT id, CASE WHEN app_name = 'purchase' THEN '[private]' ELSE window_title END AS window_title, CASE WHEN app_name <> 'purchase' THEN project END AS project FROM act",
    "activity_projects": _with(ACT) + "SELECT project, max(timestamp) AS last_active FROM act WHERE project IS NOT NULL GROUP BY 1",
    "retention": _with(ACT) + "SELECT count(*) AS kept, min(timestamp) AS first FROM act WHERE timestamp >= (SELECT max(timestamp) - 604800000 FROM act)",
    "current_activity": _with(ACT) + "SELECT user_id, arg_max(app_name, (timestamp, id)) AS app_name, max(timestamp) AS last FROM act GROUP BY 1",
    "recent_ring": _with(ACT) + "SELECT id, timestamp FROM act ORDER BY timestamp DESC, id DESC LIMIT 100",
    "reward_trend": "WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), r AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM l) SELECT round(coalesce(regr_slope(value, i), 0), 6) AS trend FROM r",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(value) FILTER (WHERE i = n // 2), 6) AS p50, round(max(value) FILTER (WHERE i = least(n * 99 // 100, n - 1)), 6) AS p99 FROM r GROUP BY 1""",
    "clipboard_changes": "SELECT event_id, trim(event_type) AS copied FROM events WHERE trim(event_type) <> '' QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type",
    "time_labels": _with(ACT, f"m AS (SELECT id, CAST(floor(({fx.AS_OF} - timestamp) / 60000) AS BIGINT) AS m, ({fx.AS_OF} - timestamp) / 86400000 AS d FROM act)")
    + "SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago, CAST(CASE WHEN d <= 7 THEN 0.7 WHEN d <= 30 THEN 0.55 ELSE 0.4 END AS DOUBLE) AS quality FROM m",
    "residual_gate": "WITH r AS (SELECT event_id, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS e FROM events) SELECT event_id, round(abs(value - e), 6) AS residual FROM r WHERE abs(value - e) > 0.5 * greatest(abs(e), 1e-9)",
    "history_importance": _with(HIST) + """SELECT url, visit_count, CAST(CASE WHEN visit_count > 20 THEN 0.7 WHEN visit_count > 5 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS sync,
  round(CAST(least(0.3 + CASE WHEN visit_count > 20 THEN 0.4 WHEN visit_count > 5 THEN 0.2 WHEN visit_count > 2 THEN 0.1 ELSE 0 END, 1) AS DOUBLE), 6) AS history,
  round(CAST(least(0.3 + CASE WHEN visit_count * 100 > 10000 THEN 0.3 WHEN visit_count * 100 > 1000 THEN 0.2 WHEN visit_count * 100 > 100 THEN 0.1 ELSE 0 END, 1) AS DOUBLE), 6) AS frecency,
  last_visit_time // 1000 - 11644473600000 AS last_ms FROM hist""",
    "search_term_batches": """WITH t AS (SELECT DISTINCT event_type AS profile, json_extract_string(props, '$.k') AS term FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY term) AS n FROM t)
SELECT profile, CAST(floor((n - 1) / 20) AS BIGINT) AS batch, string_agg(term, ',' ORDER BY n) AS content, count(*) AS items FROM n GROUP BY 1, 2""",
    "incremental_sync": _with(HIST) + f"SELECT page_id, url, last_visit_time FROM hist WHERE last_visit_time > {(fx.T0 // 1000 + 11644473600) * 1000000} ORDER BY last_visit_time, page_id LIMIT 40",
    "url_rollup": _with(HIST) + "SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, count(*) AS urls, CAST(sum(visit_count) AS BIGINT) AS visits, arg_max(url, (visit_count, url)) AS top_url FROM hist GROUP BY 1",
    "sparse_codes": _with(
        MEM, "m0 AS (SELECT i, j, CAST((i::UHUGEINT * 11400714819323198485::UHUGEINT + j::UHUGEINT * 14029467366897019727::UHUGEINT + 42::UHUGEINT * 1609587929392839161::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS m FROM range(64) a(i), range(256) b(j))",
        "m1 AS (SELECT i, j, CAST((CAST(xor(m, m >> 29) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS m FROM m0)",
        "planes AS (SELECT j, list((CAST(xor(m, m >> 32) >> 11 AS DOUBLE) / 9007199254740992 * 2 - 1) * sqrt(3 / 64) ORDER BY i) AS p FROM m1 GROUP BY j)",
        "best AS (SELECT id, j, list_dot_product(vector, p) AS y FROM memories, planes QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_dot_product(vector, p) DESC, j) <= 10)",
    ) + "SELECT id, list(CAST(j AS INT) ORDER BY j) AS code, round(least(1, sum(greatest(y, 0)) / 10), 6) AS novelty FROM best GROUP BY id",
    "hash_embed": _with(_hashed("e", "documents", "doc_id", "text", 64)) + "SELECT doc_id, list_transform(v, lambda x: round(x, 6)) AS embedding FROM documents LEFT JOIN e USING (doc_id)",
    "fused_context_budget": _with(*FUSED) + f"SELECT source, id, chars, md5({_cut('content', 'chars')}) AS content FROM b",
    "rerank_blend": _with(MEM, Q, _recalled()) + "SELECT id, round(0.7 * similarity + (1 - 0.7::DOUBLE) * list_cosine_similarity(vector, q), 6) AS score FROM hits",
    "rerank_pairs": _with(MEM, EDGES, LOG) + """SELECT selected, other, count(*) AS n, any_value(round(1.0::DOUBLE + 10 * sa + 100 * sr + 1000 * st, 6)) AS f_selected, any_value(round(0.5::DOUBLE + 10 * oa + 100 * ors + 1000 * ot, 6)) AS f_other FROM pairs_of GROUP BY 1, 2""",
    "rerank_step": _with(MEM, EDGES, LOG, STEP) + """SELECT 'w1' AS name, CAST(j AS INT) AS i, CAST(h AS INT) AS h, round(0.1 * sin(1 + j * 4 + h) - 0.5 / n * g, 6) AS value FROM g1, total
UNION ALL SELECT 'b1', 0, CAST(h AS INT), round(0 - 0.5 / n * g, 6) FROM gb, total
UNION ALL SELECT 'w2', 0, CAST(h AS INT), round(0.1 * sin(1 + h) - 0.5 / n * g, 6) FROM g2, total UNION ALL SELECT 'b2', 0, 0, 0.0""",
    "rerank_learned": _with(
        MEM, EDGES, LOG, STEP, Q, _recalled(),
        "new1 AS (SELECT h, list(0.1 * sin(1 + j * 4 + h) - 0.5 / n * g ORDER BY j) AS w FROM g1, total GROUP BY h), new_b AS (SELECT h, -0.5 / n * g AS b FROM gb, total), new2 AS (SELECT h, 0.1 * sin(1 + h) - 0.5 / n * g AS w FROM g2, total)",
        f"hf AS (SELECT h.id, similarity, h.vector, q, [similarity, ln(1 + h.access_count) / 10, exp((h.timestamp - {fx.AS_OF}) / 86400000), CASE WHEN h.memory_type = 'Semantic' THEN 1.0 ELSE 0.0 END::DOUBLE] AS fs FROM hits h)",
        "o AS (SELECT id, any_value(similarity) AS s, sum(greatest(0, list_dot_product(q || vector, n1.w) + b) * n2.w) + any_value(list_dot_product(fs, (SELECT list(w ORDER BY h) FROM new2 WHERE h >= 4))) AS out FROM hf, new1 n1 JOIN new_b USING (h) JOIN new2 n2 USING (h) GROUP BY id)",
    ) + "SELECT id, round(0.7 * s + (1 - 0.7::DOUBLE) / (1 + exp(-out)), 6) AS score FROM o",
    "rerank_features": _with(MEM, Q, _recalled()) + f"SELECT id, round(ln(1 + access_count) / 10, 6) AS f_access, round(exp((timestamp - {fx.AS_OF}) / 86400000), 6) AS f_recency, CASE WHEN memory_type = 'Semantic' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_type, round(similarity, 6) AS f_index FROM hits",
    "pattern_boost": _with(MEM, Q, "n AS (SELECT greatest(list_cosine_similarity(vector, q), 0) AS w, importance AS quality FROM memories, q ORDER BY list_cosine_similarity(vector, q) DESC, id LIMIT 5)") + "SELECT round(coalesce(sum(w * quality) / nullif(sum(w), 0), 0.5), 6) AS boost FROM n",
    "memory_context": _with(MEM, Q, _recalled(k=5), "r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM hits)") + "SELECT string_agg(printf('%d. [%s] (similarity: %.2f): %s', r, lower(memory_type), similarity, 'content of ' || id), chr(10) ORDER BY r) AS context FROM r",
    "query_log": _with(MEM, Q, _recalled(k=5)) + "SELECT list(id ORDER BY similarity DESC, id) AS result_ids, first(id ORDER BY similarity DESC, id) AS selected_id FROM hits",
    "fan_out": _with(FILES, MAIL, ACT) + """SELECT * FROM (SELECT 'document' AS source, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'email', CAST(message_id AS VARCHAR) FROM mail WHERE contains(lower(subject), 'the') ORDER BY message_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'chat', conv_id || '/' || turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'page', CAST(page_id AS VARCHAR) FROM pages WHERE contains(lower(html), 'the') ORDER BY page_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'activity', CAST(id AS VARCHAR) FROM act WHERE contains(lower(window_title), 'the') ORDER BY id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'file', path FROM files WHERE contains(lower(name), 'the') ORDER BY path LIMIT 5)""",
    "q_learning": """WITH q AS (SELECT DISTINCT user_id % 20 AS state, event_id % 4 AS action, ((user_id % 20) * 7 + (event_id % 4) * 3) % 10 / 10 AS value FROM events),
x AS (SELECT user_id % 20 AS state, event_id % 4 AS action, event_id % 5 / 4 AS reward, (user_id + 1) % 20 AS next_state, event_id % 9 = 0 AS done FROM events),
b AS (SELECT state AS next_state, max(value) AS best FROM q GROUP BY 1),
t AS (SELECT state, action, avg(reward + 0.95 * CASE WHEN done THEN 0 ELSE coalesce(best, 0) END) AS target, count(*) AS n FROM x LEFT JOIN b USING (next_state) GROUP BY 1, 2)
SELECT state, action, round(CASE WHEN target IS NULL THEN coalesce(value, 0) ELSE coalesce(value, 0) + 0.1 * (target - coalesce(value, 0)) END, 6) AS value, coalesce(n, 0) AS visits FROM q FULL JOIN t USING (state, action)""",
    "learn_loop": _learn(5, "SELECT state, action, round(value, 6) AS value, visits FROM q5"),
    "learn_rounds": _learn(5, "SELECT round, drawn, round(error, 6) AS error FROM (" + " UNION ALL ".join(f"SELECT * FROM l{r}" for r in range(1, 6)) + ") WHERE drawn > 0"),
    "explored_actions": f"""WITH q AS (SELECT user_id % 50 AS state, event_id % 4 AS action, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
g AS (SELECT *, value / 20 - ln(-ln(({hashed("'1|3|' || state || '|' || action")} + 1) / 4503599627370496.0 * (1 - 1e-12::DOUBLE))) AS noisy FROM q),
s AS (SELECT state, arg_max(action, {{'v': value, 'a': -action}}) AS best, arg_max(action, {{'v': noisy, 'a': -action}}) AS softmax_action, list(DISTINCT action ORDER BY action) AS actions, ({hashed("'1|3|' || state")} + 1) / 4503599627370496.0 AS u FROM g GROUP BY state)
SELECT state, best, CASE WHEN u < 0.3 THEN actions[CAST(least(floor(u / 0.3::DOUBLE * len(actions)), len(actions) - 1) AS INT) + 1] ELSE best END AS epsilon_action, softmax_action FROM s""",
    "pattern_bank": _bank(3),
    "greedy_actions": "WITH q AS (SELECT user_id % 20 AS state, event_id % 4 AS action, round(avg(value), 6) AS value FROM events GROUP BY 1, 2) SELECT state, action FROM q QUALIFY row_number() OVER (PARTITION BY state ORDER BY value DESC, action) = 1",
    "reward_signals": """WITH e AS (SELECT event_id, (event_id % 21 - 10) / 5 AS x, event_id % 5 AS v FROM events)
SELECT event_id, round(least(greatest((x + 1) / 2, 0), 1), 6) AS quality, round(CASE WHEN v = 0 THEN 1 ELSE 1 / (1 + sqrt(v)) END, 6) AS curiosity, round(1 / (1 + exp(-x)), 6) AS sigmoid,
  round(CAST(CASE WHEN x / 10 < -0.05 THEN 0.11 WHEN x / 10 > 0.05 THEN 0.095 ELSE 0.1 END AS DOUBLE), 6) AS exploration FROM e""",
    "synchrony": "SELECT round(sqrt(pow(avg(cos(p)), 2) + pow(avg(sin(p)), 2)), 6) AS synchrony FROM (SELECT event_id % 100 / 50 AS p FROM events)",
    "hopfield_retrieve": _with(MEM, Q, "t AS (SELECT id, list_cosine_similarity(vector, q) AS s FROM memories, q ORDER BY s DESC, id LIMIT 5)") + "SELECT id, round(s, 6) AS similarity, round(exp(8 * s) / sum(exp(8 * s)) OVER (), 6) AS weight FROM t",
    "quantized_vectors": _with(MEM, "t AS (SELECT id, vector, access_count / 22 AS s, list_max(list_transform(vector, lambda x: abs(x))) AS top FROM memories), u AS (SELECT *, CASE WHEN s > 0.8 THEN 0 WHEN s > 0.4 THEN 127 ELSE 7 END AS n FROM t)")
    + "SELECT id, CASE WHEN n = 0 THEN list_transform(vector, lambda x: round(x, 6)) ELSE list_transform(vector, lambda x: round(round(x / top * n) / n * top + 0.0, 6)) END AS vector FROM u",
    "concept_summaries": f"""WITH d AS (SELECT source, doc_id, (doc_id % 10) / 10 AS salience, CASE WHEN length(g) > 200 THEN substr(g, 1, 197) || '...' ELSE g END AS gist,
  list_filter(list_transform({_words('text')}, lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))), lambda w: strlen(w) > 2 AND NOT list_contains({_list(STOP_WORDS)}, w))[1:5] AS c
  FROM (SELECT *, string_split_regex(text, '[.!?]')[1] AS g FROM documents)),
f AS (SELECT source, concept, min((doc_id, i)) AS pos FROM (SELECT source, doc_id, unnest(c) AS concept, generate_subscripts(c, 1) AS i FROM d) GROUP BY 1, 2),
s AS (SELECT source, list(concept ORDER BY pos, concept)[1:7] AS concepts FROM f GROUP BY 1)
SELECT d.source AS topic, round(avg(salience), 6) AS salience, arg_min(gist, doc_id) AS gist, any_value(s.concepts) AS concepts FROM d LEFT JOIN s USING (source) GROUP BY 1""",
    "debounce_sessions": """WITH e AS (SELECT ts, '/p/' || user_id AS path, lag(ts) OVER (ORDER BY ts) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 600000 AS end_ms, count(*) AS changes, count(DISTINCT path) AS paths FROM s GROUP BY n""",
    "stream_activity_changes": "WITH c AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM events) SELECT user_id, count(*) AS changes FROM c WHERE b IS DISTINCT FROM event_type GROUP BY 1",
    "available_now_import": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}

ITEMS = """items AS (SELECT 'memory' AS kind, id AS key, CAST(timestamp AS BIGINT) AS timestamp, importance, CAST(access_count AS BIGINT) AS access_count, memory_type AS type, '' AS name, lower(id || chr(10) || memory_type) AS searched FROM memories
  UNION ALL SELECT 'file', path, CAST(modified AS BIGINT), 0, 0, '', name, lower(name || chr(10) || path) FROM files)"""

ORACLES |= {
    "browse_recent": _with(MEM, FILES, ITEMS) + "SELECT kind, key, timestamp, importance, access_count, type, name FROM items WHERE contains(searched, '1') ORDER BY timestamp DESC, kind, key LIMIT 100",
    "browse_important": _with(MEM, FILES, ITEMS) + "SELECT kind, key, round(importance, 6) AS importance FROM items WHERE contains(searched, 'goal') ORDER BY items.importance DESC, kind, key LIMIT 25",
    "browse_by_name": _with(MEM, FILES, ITEMS) + "SELECT kind, key, name FROM items ORDER BY name, kind, key LIMIT 1000",
    "topic_listing": _with(FILES) + """SELECT source AS topic, CAST(sum(1 + len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: starts_with(l, '### '))) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS memories, max(modified) AS modified FROM files GROUP BY 1""",
    "maintenance_policy": _with(MEM, "t AS (SELECT memory_type, count(*) AS n, avg(decay) AS d, sum(access_count) AS a FROM memories GROUP BY 1)")
    + """SELECT memory_type, concat_ws(',', CASE WHEN a % 2 > 0 THEN 'learn' END, CASE WHEN d > 0.5 THEN 'consolidate' END, CASE WHEN n > 60 THEN 'near_capacity' END, CASE WHEN n % 10 > 7 THEN 'synchronised' END) AS due,
  CASE WHEN n > 10 AND n % 10 > 5 THEN 'improving' WHEN a % 2 > 0 THEN 'declining' ELSE 'stable' END AS trend FROM t""",
    "softmax_actions": """WITH q AS (SELECT user_id % 20 AS state, event_id % 4 AS action, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
e AS (SELECT state, action, exp((value - max(value) OVER (PARTITION BY state)) / 10.0) AS w FROM q)
SELECT state, action, round(w / sum(w) OVER (PARTITION BY state), 6) AS probability FROM e""",
}

EDGES_LOW = EDGES.replace("> 0.3", "> 0.2")
SESSIONS = """e AS (SELECT ts, '/p/' || user_id AS path, lag(ts) OVER (ORDER BY ts) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)"""

ORACLES |= {
    "chunk_paragraphs": f"""WITH RECURSIVE d AS (SELECT doc_id, parts, list_transform(parts, lambda p: len({_words('p')})) AS c FROM (
  SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '{WS}', '', 'g') <> '') AS parts FROM documents) WHERE len(parts) > 0),
walk AS (SELECT doc_id, 1 AS i, c[1] AS n, 0 AS g FROM d
  UNION ALL SELECT doc_id, i + 1, CASE WHEN n + c[i + 1] > 100 THEN c[i + 1] ELSE n + c[i + 1] END, CASE WHEN n + c[i + 1] > 100 THEN g + 1 ELSE g END FROM walk JOIN d USING (doc_id) WHERE i < len(c))
SELECT doc_id, CAST(g AS BIGINT) AS n, string_agg(parts[i], chr(10) || chr(10) ORDER BY i) AS chunk FROM walk JOIN d USING (doc_id) GROUP BY doc_id, g""",
    "weighted_sample": _with(MEM)
    + "SELECT id FROM memories WHERE importance > 0 ORDER BY -ln((CAST('0x' || substr(md5('1|' || id), 1, 13) AS BIGINT)::DOUBLE + 1) / 4503599627370496.0) / importance, id LIMIT 20",
    "stream_residual_gate": """WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, value, 0.0::DOUBLE AS e FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.event_id, r.value, f.e + 0.25::DOUBLE * (f.value - f.e) FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT event_id, round(abs(value - e), 6) AS residual FROM f WHERE abs(value - e) > 0.5::DOUBLE * greatest(abs(e), 1e-9::DOUBLE)""",
    "stream_clipboard": "SELECT event_id, event_type AS copied FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type",
    "stream_retention": """SELECT user_id, epoch_ms(ts) // 86400000 AS day, count(*) AS n FROM events
WHERE (epoch_ms(ts) // 86400000 + 8) * 86400000 <= (SELECT epoch_ms(max(ts)) - 60000 FROM events) GROUP BY 1, 2""",
    "stream_debounce": f"WITH {SESSIONS} SELECT epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 600000 AS end_ms, count(*) AS changes, list_sort(list(DISTINCT path)) AS paths FROM s GROUP BY n",
    "attention_rerank": _with(
        MEM, Q, EDGES_LOW, _recalled(),
        "n AS (SELECT h.id, h.vector AS a, m.vector AS b FROM hits h JOIN edges e ON e.src = h.id JOIN memories m ON m.id = e.dst)",
        "w AS (SELECT id, hd, a[hd * 16 + 1 : hd * 16 + 16] AS pa, b[hd * 16 + 1 : hd * 16 + 16] AS pb, exp(list_dot_product(a[hd * 16 + 1 : hd * 16 + 16], b[hd * 16 + 1 : hd * 16 + 16]) / 4.0) AS w FROM n, range(4) AS t(hd))",
        "x AS (SELECT id, hd, i, any_value(pa[i]) + sum(w * pb[i]) / sum(w) AS y FROM w, range(1, 17) AS r(i) GROUP BY 1, 2, 3)",
        "v AS (SELECT id, list(y ORDER BY hd, i) AS aware FROM x GROUP BY 1)",
    ) + "SELECT h.id, round(similarity, 6) AS similarity, round(0.7 * similarity + (1 - 0.7::DOUBLE) * list_cosine_similarity(coalesce(aware, vector), q), 6) AS score FROM hits h LEFT JOIN v USING (id)",
}
