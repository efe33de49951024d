"""The same results in SQL, for checking the registered queries on the given tables."""

from __future__ import annotations

# Fixed values, written out here so that nothing of the code under test is used.
_WEIGHTS, _BUFFER, _HUMAN_BELOW, _AI_FROM = (0.6, 0.4), 5, 0.40, 0.70
FLAGGED_TITLE = "⚠️ AI Scammer Flagged"
FLAGGED_MESSAGE = "A community-flagged AI caller is calling!"
AI_TITLE = "🚨 AI Voice Detected"
ENDED_TITLE = "📴 Call Ended"
ENDED_EMPTY = "No audio frames captured"

_PARTS = """
parts AS (
  SELECT p_partkey AS pid, p_size, lower(p_type) AS kind, split_part(p_name, ' ', 2) AS word,
         p_brand AS host_id, p_type || '-' || CAST(p_partkey % 10 AS VARCHAR) AS poll_ts
  FROM part
)"""

_VOIP = "regexp_matches(lower(word), 'ring|gear|economy')"
_VOIP_CHAIN = f"({_VOIP} OR regexp_matches(kind, 'ring|gear|economy'))"

_MIC = """
claims AS (
  SELECT host_id, poll_ts, CASE WHEN p_size % 2 = 1 THEN word END AS exe,
         (pid % 7) > (p_size % 5) AS used
  FROM parts
),
running AS (SELECT DISTINCT host_id, poll_ts, word AS exe FROM parts WHERE p_size > 25),
mic AS (
  SELECT c.host_id, c.poll_ts,
         bool_or(c.used AND (c.exe IS NULL OR r.exe IS NOT NULL)) AS mic_in_use
  FROM claims c
  LEFT JOIN running r ON r.host_id = c.host_id AND r.poll_ts = c.poll_ts AND r.exe = c.exe
  GROUP BY 1, 2
)"""

_SOURCES = f"""
m1 AS (
  SELECT host_id, poll_ts, pid, word AS name, kind || '>' || word AS chain, 1 AS method
  FROM parts WHERE p_size % 2 = 1 AND pid <> 0 AND {_VOIP_CHAIN}
),
m2 AS (
  SELECT p.host_id, p.poll_ts, p.pid, p.word AS name, p.kind || '>' || p.word AS chain, 2 AS method
  FROM parts p JOIN mic m ON m.host_id = p.host_id AND m.poll_ts = p.poll_ts AND m.mic_in_use
  WHERE p.p_size > 25 AND {_VOIP}
    AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.host_id = p.host_id
                    AND m1.poll_ts = p.poll_ts AND m1.pid = p.pid)
),
sources AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)"""


def _latch(require_mic: bool = True) -> str:
    told = (
        "CASE WHEN audio AND mic THEN true WHEN NOT audio THEN false END" if require_mic else "audio"
    )
    return f"""
polls AS (
  SELECT user_id AS host_id, ts AS poll_ts, event_id, event_type <> 'error' AS audio,
         event_type IN ('click', 'purchase') AS mic
  FROM events
),
latched AS (
  SELECT host_id, poll_ts, event_id,
         coalesce(last_value({told} IGNORE NULLS) OVER (
           PARTITION BY host_id ORDER BY poll_ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS active
  FROM polls
),
edges AS (
  SELECT *, lag(active, 1, false) OVER (PARTITION BY host_id ORDER BY poll_ts, event_id) AS was_active
  FROM latched
)"""


_SESSIONS = """
ordinals AS (
  SELECT *, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER (
           PARTITION BY host_id ORDER BY poll_ts, event_id) AS n
  FROM edges WHERE active <> was_active
),
sessions AS (
  SELECT host_id, CAST(n AS BIGINT) AS call_ordinal,
         CAST(host_id AS VARCHAR) || '#' || CAST(CAST(n AS BIGINT) AS VARCHAR) AS call_id,
         min(CASE WHEN active THEN poll_ts END) AS start_ts,
         max(CASE WHEN NOT active THEN poll_ts END) AS end_ts
  FROM ordinals GROUP BY host_id, n
)"""

_CALLER = r"""
found AS (
  SELECT doc_id AS call_id, regexp_extract_all(text, '[+0-9A-Za-z][0-9 ().-]{2,}[0-9]') AS l
  FROM documents
),
texts AS (
  SELECT call_id, pos, l[pos] AS txt
  FROM (SELECT call_id, l, unnest(range(1, len(l) + 1)) AS pos FROM found)
),
numbers AS (
  SELECT call_id, pos, CASE WHEN length(txt) > 10 THEN 'Voice call' ELSE 'Video call' END AS window_name,
         CASE WHEN pos <= 15 AND starts_with(trim(txt), '+') AND NOT regexp_matches(txt, '[A-Za-z]')
               AND length(regexp_replace(txt, '[^0-9]', '', 'g')) >= 7
              THEN '+' || regexp_replace(txt, '[^0-9]', '', 'g') END AS number
  FROM texts
),
best AS (SELECT call_id, max(window_name) AS window_name FROM numbers GROUP BY 1),
caller AS (
  SELECT n.call_id, arg_min(n.number, n.pos) FILTER (WHERE n.number IS NOT NULL) AS caller_number
  FROM numbers n JOIN best b ON b.call_id = n.call_id AND b.window_name = n.window_name
  GROUP BY 1
)"""

_BLOCKLIST = """
blocklist AS (
  SELECT sha256(c_name) AS phone_hash,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_nationkey % 3 AS INTEGER) END AS strike_count,
         TIMESTAMP '1994-01-01 00:00:00' + to_days(c_nationkey) AS last_flagged_at
  FROM customer WHERE c_mktsegment <> 'MACHINERY'
)"""

_ORDER_CALLS = """
calls AS (
  SELECT o_orderkey AS call_id, o_orderdate AS end_ts, o_orderstatus = 'F' AS call_was_ai,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN sha256(c_name) END AS caller_hash
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""


def _decided(only_heard: bool = False, w: tuple[float, float] = _WEIGHTS) -> str:
    n, where = _BUFFER, "WHERE event_type <> 'error'" if only_heard else ""
    by = "PARTITION BY call_id ORDER BY ts, event_id"

    def label(c: str) -> str:
        return (
            f"CASE WHEN {c} < {_HUMAN_BELOW} THEN 'Human'"
            f" WHEN {c} < {_AI_FROM} THEN 'Suspicious' ELSE 'AI Generated' END"
        )

    return f"""
scores AS (
  SELECT user_id AS call_id, ts, event_id,
         CASE WHEN event_type <> 'signup' THEN least(value / 100, 1.0::DOUBLE) END AS cnn,
         CASE WHEN event_type <> 'purchase'
              THEN (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) + 0.3137::DOUBLE) / 100 END AS gmm
  FROM events {where}
),
ensembles AS (
  SELECT *, coalesce({w[0]}::DOUBLE * cnn + {w[1]}::DOUBLE * gmm, cnn, gmm, 0.0::DOUBLE) AS ensemble_score
  FROM scores
),
averages AS (
  SELECT *, avg(ensemble_score) OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS average_score,
         list(ensemble_score) OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS held,
         row_number() OVER ({by}) AS seq
  FROM ensembles
),
labels AS (SELECT *, {label('average_score')} AS label FROM averages),
decided AS (
  SELECT *, CAST(least(seq, {n}) AS INTEGER) AS frames_buffered, seq >= {n} AS buffer_full,
         seq >= {n} AND label = 'AI Generated'
           AND (seq = {n} OR lag(label) OVER ({by}) <> 'AI Generated') AS should_notify
  FROM labels
)"""


_SHOWN = "CASE label WHEN 'Human' THEN 'HUMAN' WHEN 'Suspicious' THEN 'SUSPICIOUS' ELSE 'AI' END"
_DETAIL = (
    "concat_ws(' · ', 'CNN: ' || format('{:.1f}', cnn * 100) || '%',"
    " 'GMM: ' || format('{:.1f}', gmm * 100) || '%')"
)

_ROLLUP = f"""
rolled AS (
  SELECT f.call_id, coalesce(bool_or(d.label = 'AI Generated'), false) AS call_was_ai,
         count(*) AS frames_processed,
         arg_max({_SHOWN}, struct_pack(t := d.ts, e := d.event_id)) FILTER (WHERE d.event_id IS NOT NULL)
           AS last_label,
         arg_max(d.average_score * 100, struct_pack(t := d.ts, e := d.event_id))
           FILTER (WHERE d.event_id IS NOT NULL) AS last_confidence
  FROM (SELECT user_id AS call_id, event_id FROM events) f
  LEFT JOIN decided d ON d.event_id = f.event_id
  GROUP BY 1
)"""

_ENDED = f"""CASE WHEN frames_processed > 0
  THEN 'Analyzed ' || CAST(frames_processed AS VARCHAR) || ' frames' || chr(10) || 'Last: '
       || coalesce(last_label, '—') || ' (' || format('{{:.1f}}', coalesce(last_confidence, 0.0::DOUBLE)) || '%)'
  ELSE '{ENDED_EMPTY}' END"""

_CALLS = """
spans AS (SELECT user_id AS call_id, min(ts) AS start_ts, max(ts) AS end_ts FROM events GROUP BY 1),
calls AS (
  SELECT s.call_id, s.start_ts, s.end_ts, coalesce(b.strike_count, 0) > 0 AS is_caller_flagged,
         r.call_was_ai, r.frames_processed, r.last_label, r.last_confidence
  FROM spans s JOIN rolled r ON r.call_id = s.call_id
  LEFT JOIN blocklist b ON b.phone_hash = sha256(printf('Customer#%09d', s.call_id))
)"""

_RESULTS = """
results AS (
  SELECT user_id AS call_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick, ts AS result_ts, event_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'cnn' ELSE 'gmm' END AS model,
         least(value, 100.0::DOUBLE) AS confidence_pct
  FROM events
)"""

_UPDATES = """
updates AS (
  SELECT call_id, tick, max(result_ts) AS result_ts,
         arg_max(confidence_pct, result_ts) FILTER (WHERE model = 'cnn') / 100.0::DOUBLE AS cnn,
         arg_max(confidence_pct, result_ts) FILTER (WHERE model = 'gmm') / 100.0::DOUBLE AS gmm
  FROM results GROUP BY 1, 2
)"""


# Signed results get "+ 0.0", as rounding can leave a negative zero in SQL.
def _list_sum(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda v: CAST(v AS DOUBLE)))"


def _shape(x: str, name: str) -> str:
    return (
        f"CAST(len({x}) AS BIGINT) AS {name}_n, round({_list_sum(x)}, 6) + 0.0 AS {name}_sum,"
        f" round(CAST({x}[1] AS DOUBLE), 6) + 0.0 AS {name}_first,"
        f" round(CAST({x}[len({x})] AS DOUBLE), 6) + 0.0 AS {name}_last"
    )


_QUIET = """
quiet AS (
  SELECT vec_id, label, embedding,
         len(list_filter(range(0, 8), lambda i: 20 * log10(sqrt(list_sum(list_transform(
           embedding[i * 8 + 1 : i * 8 + 8], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 8
           + 1e-12) + 1e-12) < -18.0)) / 8.0::DOUBLE AS silence_ratio
  FROM embeddings
)"""


def _terms(weights: list[float], means: list[list[float]], variances: list[list[float]]) -> list[str]:
    """Log of weight times density of vector ``x`` per component of a diagonal mixture."""
    terms = []
    for w, mean, var in zip(weights, means, variances, strict=True):
        squares = " + ".join(
            f"power(x[{i + 1}] - ({m}::DOUBLE), 2) / {v}::DOUBLE" for i, (m, v) in enumerate(zip(mean, var, strict=True))
        )
        dets = " + ".join(f"ln({v}::DOUBLE)" for v in var)
        terms.append(f"ln({w}::DOUBLE) - 0.5 * ({squares} + {dets} + {len(mean)} * ln(2 * pi()))")
    return [f"({t})" for t in terms]


def _mixture(weights: list[float], means: list[list[float]], variances: list[list[float]]) -> str:
    """Log density of vector ``x`` under a diagonal mixture, largest term taken out."""
    first, second = _terms(weights, means, variances)
    return f"greatest({first}, {second}) + ln(1 + exp(-abs({first} - {second})))"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_HUMAN = ([0.6, 0.4], [[0.05, -0.05, 0.0, 0.1], [-0.1, 0.1, 0.05, 0.0]], [[0.02, 0.03, 0.025, 0.02], [0.015, 0.02, 0.03, 0.025]])
_AI = ([0.5, 0.5], [[0.0, 0.05, -0.05, 0.0], [0.1, 0.0, 0.1, -0.1]], [[0.01, 0.02, 0.015, 0.03], [0.03, 0.01, 0.02, 0.02]])


def _refit_sql() -> str:
    """One step of expectation and maximisation from both mixtures."""
    human, ai = _terms(*_HUMAN), _terms(*_AI)
    return f"""
WITH fours AS (
  SELECT label < 5 AS is_ai, unnest(list_transform(range(0, 16), lambda b: embedding[b * 4 + 1 : b * 4 + 4])) AS y FROM embeddings),
vectors AS (SELECT is_ai, list_transform(y, lambda v: CAST(v AS DOUBLE)) AS x FROM fours WHERE is_ai IS NOT NULL),
odds AS (SELECT CASE WHEN is_ai THEN 'ai' ELSE 'human' END AS model, x,
                CASE WHEN is_ai THEN {ai[1]} - {ai[0]} ELSE {human[1]} - {human[0]} END AS o FROM vectors),
shares AS (SELECT model, x, unnest([0, 1]) AS component, unnest([1 / (1 + exp(o)), 1 / (1 + exp(-o))]) AS share FROM odds),
sizes AS (SELECT model, component, sum(share) AS n, sum(sum(share)) OVER (PARTITION BY model) AS total FROM shares GROUP BY 1, 2),
axes AS (SELECT unnest([0, 1, 2, 3]) AS i),
means AS (SELECT model, component, i, sum(share * x[i + 1]) / sum(share) AS mean FROM shares, axes GROUP BY 1, 2, 3),
covs AS (
  SELECT s.model, s.component, a.i, b.i AS j, sum(share * (x[a.i + 1] - a.mean) * (x[b.i + 1] - b.mean)) / sum(share) AS cov
  FROM shares s JOIN means a ON a.model = s.model AND a.component = s.component
  JOIN means b ON b.model = s.model AND b.component = s.component GROUP BY 1, 2, 3, 4)
SELECT c.model, CAST(c.component AS INTEGER) AS component, CAST(c.i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(n / total, 6) AS weight, round(mean, 6) + 0.0 AS mean, round(cov, 6) + 0.0 AS cov
FROM covs c JOIN sizes z ON z.model = c.model AND z.component = c.component
JOIN means m ON m.model = c.model AND m.component = c.component AND m.i = c.i"""


def _gmm_sql() -> str:
    human, ai = _mixture(*_HUMAN), _mixture(*_AI)
    return f"""
WITH fours AS (
  SELECT vec_id, unnest(list_transform(range(0, 16), lambda i: embedding[i * 4 + 1 : i * 4 + 4])) AS y
  FROM embeddings
),
vectors AS (SELECT vec_id, list_transform(y, lambda v: CAST(v AS DOUBLE)) AS x FROM fours),
logs AS (SELECT vec_id, {human} AS h, {ai} AS a FROM vectors),
means AS (SELECT vec_id, avg(h) AS h, avg(a) AS a FROM logs GROUP BY 1),
scored AS (SELECT *, 100 / (1 + exp(-0.5 * (a - h))) AS pct FROM means)
SELECT vec_id, round(h, 6) + 0.0 AS ll_human, round(a, 6) + 0.0 AS ll_ai, round(pct, 6) AS confidence_pct,
       CASE WHEN pct < 50 THEN 'HUMAN' WHEN pct < 70 THEN 'SUSPICIOUS' ELSE 'AI' END AS label
FROM scored"""


def _normalized() -> str:
    x = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
    return f"""
WITH x AS (SELECT vec_id, {x} AS x FROM embeddings),
m AS (SELECT *, list_sum(x) / len(x) AS mean, list_min(x) AS lo, list_max(x) AS hi,
             sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM x),
d AS (SELECT *, list_transform(x, lambda v: v - mean) AS c FROM m),
g AS (SELECT *, sqrt(list_sum(list_transform(c, lambda v: v * v)) / len(c)) AS level FROM d),
o AS (SELECT vec_id, list_transform(x, lambda v: v * (0.1::DOUBLE / rms)) AS rms,
             list_transform(c, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v * (0.1::DOUBLE / level)))) AS dc,
             list_transform(x, lambda v: (v - lo) / (hi - lo + 1e-10)) AS unit FROM g)
SELECT vec_id, {_shape('rms', 'rms')}, {_shape('dc', 'dc')}, {_shape('unit', 'unit')} FROM o"""


_PCM = "trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(v AS DOUBLE))) * 32767) / 32768"

_AUDIO = """
samples AS (SELECT vec_id, list_transform(embedding, lambda v: {sample}) AS x FROM embeddings),
powers AS (
  SELECT vec_id, list_transform(x, lambda v: v * v) AS p, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM samples
),
-- A frame is the vector 2250 times over. A chunk is 2400 samples: 37 whole vectors
-- and half of one, the first half in even chunks and the second half in odd ones.
sums AS (SELECT vec_id, peak, list_sum(p) AS total, list_sum(p[1:32]) AS front, list_sum(p[33:64]) AS back FROM powers),
db AS (
  SELECT vec_id, peak, 20 * log10(sqrt((37 * total + front) / 2400 + 1e-12) + 1e-12) AS even,
         20 * log10(sqrt((37 * total + back) / 2400 + 1e-12) + 1e-12) AS odd FROM sums
),
quiet AS (
  SELECT vec_id, peak, (CASE WHEN even < -40 THEN 0.5::DOUBLE ELSE 0 END)
                       + (CASE WHEN odd < -40 THEN 0.5::DOUBLE ELSE 0 END) AS silence_ratio FROM db
)"""

_BANK = """
-- Spectrogram of 64-sample vectors: transform 64, hop 16, window 48, 8 bands from 100 to 7000 Hz.
points AS (
  SELECT i, 100 * 3 / 200.0::DOUBLE + i * (15 + ln(7.0::DOUBLE) * 27 / ln(6.4::DOUBLE) - 100 * 3 / 200.0::DOUBLE) / 9 AS mel
  FROM (SELECT unnest(range(0, 10)) AS i)
),
edges AS (
  SELECT i, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp((mel - 15) * ln(6.4::DOUBLE) / 27) END AS hz FROM points
),
bank AS (
  SELECT CAST(a.i AS INTEGER) AS band, k,
         greatest(0.0::DOUBLE, least((k * 250.0::DOUBLE - a.hz) / (b.hz - a.hz), (c.hz - k * 250.0::DOUBLE) / (c.hz - b.hz)))
           * 2 / (c.hz - a.hz) AS weight
  FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2,
       (SELECT unnest(range(0, 33)) AS k)
),
samples AS (
  SELECT vec_id, t, CAST(embedding[t + 1] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS t FROM embeddings)
),
framed AS (
  -- Column c sees the samples from 16 c - 32; the window fills the middle 48 of 64.
  SELECT vec_id, CAST(c AS INTEGER) AS col, t - 16 * c + 32 AS n,
         v * (0.5 - 0.5 * cos(2 * pi() * (t - 16 * c + 32 - 8) / 48)) AS v
  FROM samples, (SELECT unnest(range(0, 5)) AS c)
  WHERE t - 16 * c + 32 BETWEEN 8 AND 55
),
turns AS (
  SELECT k, n, cos(2 * pi() * k * n / 64) AS re, sin(2 * pi() * k * n / 64) AS im
  FROM (SELECT unnest(range(0, 33)) AS k), (SELECT unnest(range(0, 64)) AS n)
),
bins AS (
  SELECT vec_id, col, k, power(sum(v * re), 2) + power(sum(v * im), 2) AS p
  FROM framed JOIN turns USING (n) GROUP BY 1, 2, 3
),
mels AS (
  SELECT vec_id, band, col, sum(p * weight) AS power FROM bins JOIN bank USING (k) WHERE weight > 0 GROUP BY 1, 2, 3
)"""

_RESAMPLE = """
-- One third of the rate: sinc below 0.95 of the new band, 102 taps to each side, Kaiser window with 12.
raw AS (
  SELECT j, (0.95::DOUBLE / 3) * CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j * 0.95 / 3) / (pi() * j * 0.95 / 3) END
            * list_sum(list_transform(range(0, 60), lambda k:
                CASE WHEN k = 0 THEN 1.0::DOUBLE
                     ELSE exp(k * ln(36.0::DOUBLE * (1 - power(j / 103.0::DOUBLE, 2))) - 2 * lgamma(k + 1)) END)) AS tap
  FROM (SELECT unnest(range(-102, 103)) AS j)
),
taps AS (SELECT j, tap / sum(tap) OVER () AS tap FROM raw),
samples AS (
  SELECT vec_id, t, CAST(embedding[t + 1] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS t FROM embeddings)
)"""


def oracle_sql() -> dict[str, str]:
    zero = "0.0::FLOAT"
    head = "embedding[1:41]"
    center = "embedding[12:52]"
    pad_head = f"list_concat(embedding, list_transform(range(0, 17), lambda i: {zero}))"
    pad_center = (
        f"list_concat(list_concat(list_transform(range(0, 8), lambda i: {zero}), embedding),"
        f" list_transform(range(0, 9), lambda i: {zero}))"
    )
    mono = (
        "list_transform(range(0, 32), lambda i:"
        " (CAST(embedding[i * 2 + 1] AS DOUBLE) + CAST(embedding[i * 2 + 2] AS DOUBLE)) / 2)"
    )
    shapes = f"SELECT vec_id, {_shape('a', 'cut')}, {_shape('b', 'pad')}, {_shape('embedding', 'inner')}"
    listed = f"CASE WHEN s < {_HUMAN_BELOW} THEN 'Human' WHEN s < {_AI_FROM} THEN 'Suspicious' ELSE 'AI Generated' END"
    found = {
        "voip_source_filter": _with(_PARTS)
        + f"SELECT DISTINCT host_id, poll_ts, pid FROM parts WHERE p_size % 2 = 1 AND pid <> 0 AND {_VOIP_CHAIN}",
        "voip_mic_pids": _with(_PARTS)
        + f"SELECT DISTINCT host_id, poll_ts, pid FROM parts WHERE p_size % 3 = 1 AND pid <> 0 AND {_VOIP}",
        "voip_two_method_union": _with(_PARTS, _MIC, _SOURCES) + "SELECT * FROM sources",
        "mic_usage_tree": _with(_PARTS, _MIC) + "SELECT host_id, poll_ts, mic_in_use FROM mic",
        "mic_in_use_by_voip": _with(_PARTS)
        + f"""SELECT host_id, poll_ts, bool_or(p_size % 3 = 1 AND pid <> 0 AND {_VOIP}) AS mic_in_use_by_voip
FROM parts GROUP BY 1, 2""",
        "poll_status": _with(_PARTS, _MIC, _SOURCES)
        + f"""
SELECT m.host_id, m.poll_ts, CAST(coalesce(s.n, 0) AS BIGINT) AS n_sources, coalesce(s.n, 0) > 0 AS has_voip_audio,
       coalesce(s.n, 0) > 0 AND m.mic_in_use AS mic_active, v.rec AS mic_in_use_by_voip,
       coalesce(s.n, 0) > 0 AS active_loose, coalesce(s.n, 0) > 0 AND m.mic_in_use AS active_strict
FROM mic m
LEFT JOIN (SELECT host_id, poll_ts, count(*) AS n FROM sources GROUP BY 1, 2) s USING (host_id, poll_ts)
JOIN (SELECT host_id, poll_ts, bool_or(p_size % 3 = 1 AND pid <> 0 AND {_VOIP}) AS rec FROM parts GROUP BY 1, 2) v
  USING (host_id, poll_ts)""",
        "hysteresis_latch": _with(_latch()) + "SELECT host_id, event_id, active FROM latched",
        "loose_latch": _with(_latch(False)) + "SELECT host_id, event_id, active, was_active FROM edges",
        "call_edges": _with(_latch())
        + """SELECT host_id, event_id, poll_ts, CASE WHEN active THEN 'start' ELSE 'end' END AS edge
FROM edges WHERE active <> was_active""",
        "call_sessions": _with(_latch(), _SESSIONS)
        + """SELECT call_id, host_id, call_ordinal, start_ts, end_ts,
       round(epoch_us(end_ts) / 1e6 - epoch_us(start_ts) / 1e6, 3) AS duration_s FROM sessions""",
        "frames_in_calls": _with(_latch(), _SESSIONS)
        + """SELECT s.call_id, p.host_id, p.poll_ts AS captured_at, p.event_id
FROM polls p JOIN sessions s ON s.host_id = p.host_id AND p.poll_ts >= s.start_ts
 AND (s.end_ts IS NULL OR p.poll_ts < s.end_ts)""",
        "first_caller_id": _with(_CALLER) + "SELECT call_id, caller_number FROM caller",
        "caller_hash": _with(_CALLER)
        + "SELECT call_id, sha256(caller_number) AS caller_hash FROM caller WHERE caller_number IS NOT NULL",
        "blocklist_lookup": _with(_BLOCKLIST, _ORDER_CALLS)
        + """SELECT call_id, caller_hash, coalesce(strike_count, 0) > 0 AS is_caller_flagged
FROM calls LEFT JOIN blocklist ON phone_hash = caller_hash""",
        "blocklist_upsert": _with(
            _BLOCKLIST,
            _ORDER_CALLS,
            """
flags AS (
  SELECT caller_hash, count(*) AS n, max(end_ts) AS flagged_at FROM calls
  WHERE call_was_ai AND caller_hash IS NOT NULL GROUP BY 1
)""",
        )
        + """SELECT coalesce(phone_hash, caller_hash) AS phone_hash,
       CAST(CASE WHEN n IS NULL THEN strike_count ELSE coalesce(strike_count, 0) + n END AS DOUBLE) AS strike_count,
       CASE WHEN n IS NULL THEN last_flagged_at ELSE flagged_at END AS last_flagged_at
FROM blocklist FULL JOIN flags ON caller_hash = phone_hash""",
        "fixed_frames": """
WITH numbered AS (
  SELECT user_id AS call_id, ts, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events
)
SELECT call_id, CAST(floor(pos / 8) AS INTEGER) AS frame_seq, count(*) AS n, round(sum(value), 6) AS total,
       min(value) AS low, max(value) AS high, arg_min(value, pos) AS first
FROM numbered GROUP BY 1, 2 HAVING count(*) = 8""",
        "silence_ratio": _with(_QUIET)
        + "SELECT vec_id, silence_ratio, silence_ratio > 0.4 AS is_silent FROM quiet",
        "max_amplitude": """SELECT vec_id,
  CAST(list_max(list_transform(embedding, lambda v: abs(v))) AS DOUBLE) AS max_amplitude FROM embeddings""",
        "drop_silent": _with(_QUIET)
        + "SELECT vec_id, label, silence_ratio FROM quiet WHERE silence_ratio <= 0.4",
        "fit_center": f"{shapes} FROM (SELECT vec_id, embedding, {center} AS a, {pad_center} AS b FROM embeddings)",
        "fit_head": f"{shapes} FROM (SELECT vec_id, embedding, {head} AS a, {pad_head} AS b FROM embeddings)",
        "rms_normalize": _normalized(),
        "downmix": f"SELECT vec_id, {_shape('mono', 'mono')} FROM (SELECT vec_id, {mono} AS mono FROM embeddings)",
        "pcm16": """SELECT vec_id, array_to_string(list_transform(embedding, lambda v: CAST(trunc(
  greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(v AS DOUBLE))) * 32767) AS INTEGER)), ',') AS pcm FROM embeddings""",
        "mel_power": _with(_BANK)
        + "SELECT vec_id, band, col, round(power * 1000, 9) AS power FROM mels",
        "mel_decibels": _with(
            _BANK,
            """
raw AS (
  SELECT *, 10 * (log10(greatest(power, 1e-10::DOUBLE))
                  - log10(greatest(max(power) OVER (PARTITION BY vec_id), 1e-10::DOUBLE))) AS raw_db FROM mels
),
db AS (SELECT *, greatest(raw_db, max(raw_db) OVER (PARTITION BY vec_id) - 80) AS db FROM raw)""",
        )
        + """SELECT vec_id, band, col, round(db, 6) + 0.0 AS db,
       round((db - min(db) OVER v) / (max(db) OVER v - min(db) OVER v + 1e-10), 6) AS unit
FROM db WINDOW v AS (PARTITION BY vec_id)""",
        "cepstra": _with(_BANK)
        + """SELECT vec_id, col, CAST(k AS INTEGER) AS k,
       round(sum(ln(power + 1e-9) * cos(pi() * k * (2 * band + 1) / 16)
                 * CASE WHEN k = 0 THEN sqrt(1 / 8.0::DOUBLE) ELSE sqrt(2 / 8.0::DOUBLE) END), 6) + 0.0 AS value
FROM mels, (SELECT unnest(range(0, 4)) AS k) GROUP BY 1, 2, 3""",
        "resample": _with(_RESAMPLE)
        + """SELECT vec_id, CAST(i AS INTEGER) AS i, round(sum(v * tap), 9) + 0.0 AS value
FROM (SELECT unnest(range(0, 22)) AS i), samples JOIN taps ON j = t - 3 * i GROUP BY 1, 2""",
        "wav_round_trip": """
WITH v AS (
  SELECT vec_id, 'rec' || label || '-' || (vec_id % 2) AS call_id, CASE WHEN vec_id % 4 < 2 THEN 8000 ELSE 16000 END AS rate,
         list_transform(embedding, lambda x: CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CAST(x AS DOUBLE))) * 32767) AS BIGINT)) AS pcm
  FROM embeddings),
f AS (SELECT *, CAST(rate * 0.004 AS INTEGER) AS n, unnest(range(0, CAST(64 / (rate * 0.004) AS INTEGER))) AS part FROM v),
g AS (SELECT *, pcm[part * n + 1 : (part + 1) * n] AS own FROM f)
SELECT call_id, call_id AS recording, CAST(vec_id * 750 + part AS INTEGER) AS frame_seq, CAST(rate AS INTEGER) AS sample_rate,
       strftime(make_timestamp((vec_id * 7919 % 86400000) * 1000 + part * 4000), '%H:%M:%S.%f') AS taken,
       CAST(list_sum(own) AS BIGINT) AS total, array_to_string(own, ',') AS pcm
FROM g""",
        "audio_silence": _with(_AUDIO.format(sample="CAST(v AS DOUBLE)"))
        + "SELECT vec_id, round(silence_ratio, 9) AS silence_ratio, silence_ratio > 0.4 AS is_silent FROM quiet",
        "pcm_silence": _with(_AUDIO.format(sample=_PCM))
        + """SELECT vec_id, round(silence_ratio, 9) AS silence_ratio, silence_ratio > 0.4 AS is_silent,
       round(peak, 9) AS peak FROM quiet""",
        "gmm_confidence": _gmm_sql(),
        "fit_gmm_pair": """
WITH fours AS (
  SELECT CASE WHEN label < 5 THEN 'ai' ELSE 'human' END AS model,
         unnest(list_transform(range(0, 16), lambda b: embedding[b * 4 + 1 : b * 4 + 4])) AS x FROM embeddings),
cells AS (SELECT model, unnest(range(0, 4)) AS i, x FROM fours),
stats AS (SELECT model, i, avg(CAST(x[i + 1] AS DOUBLE)) AS mean, var_pop(CAST(x[i + 1] AS DOUBLE)) AS variance FROM cells GROUP BY 1, 2)
SELECT model, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, 1.0::DOUBLE AS weight, round(mean, 6) + 0.0 AS mean,
       round(variance, 6) AS variance
FROM stats, (SELECT unnest([2, 3]) AS k)""",
        "refit_gmm_pair": _refit_sql(),
        "train_scorer": """
WITH cells AS (
  SELECT CAST(label < 5 AS INTEGER) AS y, unnest(range(-1, 64)) AS i, embedding FROM embeddings)
SELECT CAST(i AS INTEGER) AS i, round(avg(y * CASE WHEN i < 0 THEN 1.0::DOUBLE ELSE CAST(embedding[i + 1] AS DOUBLE) END), 6) + 0.0 AS moment
FROM cells GROUP BY 1""",
        "score_frames": """
WITH z AS (
  SELECT vec_id, 0.1::DOUBLE + list_sum(list_transform(range(0, 64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * (i % 7 - 3) / 10)) AS z
  FROM embeddings),
p AS (SELECT vec_id, 100 / (1 + exp(-z)) AS pct FROM z)
SELECT vec_id, round(pct, 4) AS confidence_pct,
       CASE WHEN pct < 50 THEN 'HUMAN' WHEN pct < 70 THEN 'SUSPICIOUS' ELSE 'AI' END AS label FROM p""",
        "latency_stats": """
WITH g AS (SELECT event_type AS model, value FROM events WHERE value IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY model) AS total,
             count(*) OVER (PARTITION BY model ORDER BY value) AS seen FROM g)
SELECT model, count(*) AS n, round(sum(value) / count(*), 6) AS avg_ms,
       round(min(CASE WHEN seen >= total * 0.5::DOUBLE THEN value END), 2) AS p50_ms,
       round(min(CASE WHEN seen >= total * 0.95::DOUBLE THEN value END), 2) AS p95_ms
FROM c GROUP BY 1""",
        "latest_per_tick": _with(_RESULTS)
        + """SELECT call_id, model, tick,
       arg_max(confidence_pct, struct_pack(t := result_ts, e := event_id)) AS confidence_pct,
       max(result_ts) AS result_ts, count(*) AS n_results
FROM results GROUP BY 1, 2, 3""",
        "latest_n": """
SELECT call_id, event_id FROM (
  SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM events) WHERE n <= 20""",
        "align_scores": _with(_RESULTS, _UPDATES)
        + """SELECT call_id, tick, result_ts,
       round(last_value(cnn IGNORE NULLS) OVER w, 9) AS cnn, round(last_value(gmm IGNORE NULLS) OVER w, 9) AS gmm
FROM updates WINDOW w AS (PARTITION BY call_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "align_per_frame": _with(_RESULTS, _UPDATES)
        + "SELECT call_id, tick, result_ts, round(cnn, 9) AS cnn, round(gmm, 9) AS gmm FROM updates",
        "ensemble_score": _with(_decided())
        + f"""SELECT event_id,
       round(coalesce(0.7::DOUBLE * cnn + 0.3::DOUBLE * gmm, cnn, gmm, 0.0::DOUBLE), 9) AS default_score,
       round(ensemble_score, 9) AS app_score FROM ensembles""",
        "decision_engine": _with(_decided())
        + """SELECT call_id, event_id, round(ensemble_score, 9) AS ensemble_score,
       round(average_score, 9) AS average_score, label, should_notify, buffer_full, frames_buffered
FROM decided""",
        "buffer_scores": _with(_decided())
        + f"""SELECT event_id, CAST(len(held) AS BIGINT) AS n, round(held[1], 9) AS oldest,
       round(held[len(held)], 9) AS newest,
       array_to_string(list_transform(held, lambda s: {listed}), '|') AS labels
FROM decided""",
        "current_state": _with(
            _decided(),
            """
latest AS (
  SELECT call_id, average_score, label, frames_buffered FROM decided
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ts DESC, event_id DESC) = 1
)""",
        )
        + """SELECT c_custkey AS call_id, round(coalesce(average_score, 0.0::DOUBLE), 9) AS average_score,
       coalesce(label, 'Human') AS label, coalesce(frames_buffered, 0) AS frames_buffered
FROM customer LEFT JOIN latest ON call_id = c_custkey""",
        "call_rollup": _with(_decided(True), _ROLLUP)
        + """SELECT call_id, call_was_ai, frames_processed, last_label,
       round(last_confidence, 6) AS last_confidence FROM rolled""",
        "call_summary": _with(
            _decided(True),
            _ROLLUP,
            """
everyone AS (
  SELECT c_custkey AS call_id, coalesce(frames_processed, 0) AS frames_processed, last_label, last_confidence
  FROM customer LEFT JOIN rolled ON call_id = c_custkey
)""",
        )
        + f"""SELECT call_id, frames_processed, {_ENDED} AS summary,
       CAST(frames_processed AS VARCHAR)
         || CASE WHEN frames_processed = 1 THEN ' frame analyzed' ELSE ' frames analyzed' END AS frames_text
FROM everyone""",
        "alerts": _with(_decided(True), _ROLLUP, _BLOCKLIST, _CALLS)
        + f"""SELECT call_id, start_ts AS ts, 'flagged_caller' AS kind, '{FLAGGED_TITLE}' AS title,
       '{FLAGGED_MESSAGE}' AS message FROM calls WHERE is_caller_flagged
UNION ALL
SELECT call_id, ts, 'ai_voice', '{AI_TITLE}',
       'Smoothed: ' || format('{{:.1f}}', average_score * 100) || '% (' || {_DETAIL} || ')'
FROM decided WHERE should_notify
UNION ALL
SELECT call_id, end_ts, 'call_ended', '{ENDED_TITLE}', {_ENDED} FROM calls""",
        "caller_warnings": _with(_decided(True), _ROLLUP, _BLOCKLIST, _CALLS)
        + "SELECT call_id, start_ts AS shown_from, end_ts AS shown_to FROM calls WHERE is_caller_flagged",
        "detail_text": _with(_decided())
        + f"""SELECT event_id, {_SHOWN} AS display_label,
       CASE label WHEN 'Human' THEN 'safe' WHEN 'Suspicious' THEN 'warn' ELSE 'alert' END AS severity,
       {_DETAIL} AS detail_text FROM decided""",
        "live_decisions": _with(_decided())
        + f"""SELECT call_id, event_id, seq AS update_seq, round(average_score, 9) AS average_score, label,
       should_notify, frames_buffered,
       bool_or(label = 'AI Generated') OVER (PARTITION BY call_id ORDER BY ts, event_id) AS call_was_ai
FROM decided""",
        "live_calls": _with(_latch(), _SESSIONS)
        + f"""SELECT call_id, host_id, 'start' AS edge, epoch_us(start_ts) AS start_us, NULL::DOUBLE AS end_us
FROM sessions
UNION ALL
SELECT call_id, host_id, 'end', epoch_us(start_ts), epoch_us(end_ts)::DOUBLE
FROM sessions WHERE end_ts IS NOT NULL""",
        "call_report": _with(_decided(True), _ROLLUP, _BLOCKLIST, _CALLS)
        + """SELECT call_id, start_ts, end_ts, is_caller_flagged, call_was_ai, frames_processed,
       last_label, round(last_confidence, 6) AS last_confidence FROM calls""",
    }
    # Streams over all rows give what the batch operators give.
    live = ("frames_in_calls", "frames_in_calls"), ("rollup", "call_rollup"), ("summary", "call_summary"), ("align", "align_scores"), ("alerts", "alerts")
    live += ("caller_warnings", "caller_warnings"), ("current_state", "current_state"), ("latest_n", "latest_n")
    live += ("decisions_resumed", "live_decisions"), ("calls_resumed", "live_calls")
    return found | {f"live_{name}": found[batch] for name, batch in live}
