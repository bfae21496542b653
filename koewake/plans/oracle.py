"""SQL for DuckDB that gives the same rows as the queries, written on its own from the rules."""

from __future__ import annotations

# Fixed values, as in functions.text; DuckDB's patterns know the newer format characters.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HALF = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゙゚"
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SOUND = r"()（）*＊\-….。、,，!！?？～~♪♫"
EMPTY = r"\-….。、,，!！?？～~♪♫「」『』（）()"
JA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
FILLERS = (
    "あっ あー ああ あの あのー あのう あら あれ いや いやいや うん うーん ううん えっ えー ええ ええと えーと おっ おー おお さあ さー ちょっ ちょっと ねえ ねー "
    "はい はっ はー はあ ふーん ふむ へー へえ まあ まー もし もしもし やっ やー わっ わー んー んっ"
).split()
STATUSES = ("pending", "processing", "done", "error", "filtered")
EMOTIONS = "('neutral','happy','sad','angry','surprised','fearful','disgusted')"

_fillers = ", ".join(f"'{w}'" for w in FILLERS)
kana = lambda x: f"translate({x}, '{HALF}', '{FULL}')"
wide = lambda x: f"translate({x}, '{WIDE}', '{PLAIN}')"
blanks = lambda x: rf"regexp_replace(regexp_replace({x}, '[\t\r\n]+', ' ', 'g'), ' {{2,}}', ' ', 'g')"
control = lambda x: rf"regexp_replace({x}, '[\p{{Cc}}\p{{Cf}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
strip = lambda x: rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"
normal = lambda x: strip(control(blanks(wide(kana(x)))))
sound = lambda x: f"regexp_matches({x}, '^[{WS}{SOUND}]+$')"
japanese = lambda x: f"regexp_matches({x}, '[{JA}]')"
bare = lambda x: f"regexp_replace({x}, '[{WS}{EMPTY}]+', '', 'g')"


def label_sql(x: str) -> str:
    """A label without letter case, width and outer blanks; null where nothing is left."""
    blank = r"[\x{A0}\x{2000}-\x{200F}\x{3000}\x{FEFF}\t\r\n]"
    return f"nullif(lower(trim(translate(regexp_replace({x}, '{blank}', ' ', 'g'), '{WIDE}', '{PLAIN}'))), '')"


def dir_sql(x: str) -> str:
    """A directory in one spelling: its steps are put on a stack, which a step back shortens."""
    steps = f"list_filter(string_split(trim({x}), '/'), lambda s: s NOT IN ('', '.'))"
    root = f"starts_with(trim({x}), '/')"
    push = f"CASE WHEN s[1] <> '..' THEN list_concat(a, s) WHEN len(a) > 0 AND a[-1] <> '..' THEN a[:-2] WHEN {root} THEN a ELSE list_concat(a, s) END"
    stack = f"list_reduce(list_transform({steps}, lambda s: [s]), lambda a, s: {push}, CAST([] AS VARCHAR[]))"
    return f"nullif(CASE WHEN {root} THEN '/' ELSE '' END || array_to_string({stack}, '/'), '')"


def reason(x: str) -> str:
    s = strip(x)
    return f"""CASE WHEN {s} = '' THEN 'empty' WHEN {sound(s)} THEN 'non_verbal' WHEN NOT {japanese(s)} THEN 'no_japanese'
        WHEN length({bare(s)}) < 2 THEN 'too_short(' || length({bare(s)}) || ' chars)' WHEN {bare(s)} IN ({_fillers}) THEN 'filler_only' ELSE '' END"""


HEARD = "coalesce(nullif(raw_asr_text, ''), asr_text)"
_text = lambda e: f"SELECT id, {e} AS value FROM audio_cache WHERE asr_text IS NOT NULL"
DIR = dir_sql("source_dir")
ISSUES = "quality_issues IS NOT NULL AND quality_issues <> '[]' AND quality_issues <> ''"
_counts = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)
_dash = f"count(*) AS total, {_counts}, count(*) FILTER ({ISSUES}) AS quality_issues, count(*) FILTER (raw_asr_text <> '') AS corrected"
_pct = lambda n, t: f"coalesce(round_even({n} * 100.0::DOUBLE / nullif({t}, 0), 1), 0.0)"
_suffix = lambda x: rf"lower(regexp_extract({x}, '(\.[^./]+)$', 1))"
_short = lambda x: f"CASE WHEN {x} = '' THEN '?' ELSE split_part(split_part({x}, ':', 1), ' ', 1) END"
_whole = lambda x: f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"
_one = lambda x: f"CAST(CAST(round_even({x}, 1) AS DECIMAL(18,1)) AS VARCHAR)"
_json_list = lambda x: f"CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON)::VARCHAR[] END"

POST = f"""
    WITH d AS (
        SELECT id, status, coalesce(asr_text, '') AS raw, {strip("coalesce(asr_text, '')")} = '' AS blank, {normal("coalesce(asr_text, '')")} AS new_text
        FROM audio_cache WHERE status IN ('done', 'filtered')),
    r AS (SELECT *, CASE WHEN NOT blank THEN {reason("new_text")} END AS filter_reason FROM d),
    p AS (SELECT *, CASE WHEN blank THEN status WHEN filter_reason <> '' THEN 'filtered' ELSE 'done' END AS new_status, NOT blank AND new_text <> raw AS changed FROM r)
"""

HISTOGRAM = """
    WITH c AS (SELECT emotion, count(*) AS n FROM audio_cache WHERE status = 'done' GROUP BY 1),
    h AS (SELECT *, sum(n) OVER () AS total, max(n) OVER () AS most FROM c)
"""


def classified(strict: bool = False) -> str:
    known = "('done')" if strict else "('done', 'filtered')"
    return f"""
        WITH k AS (SELECT DISTINCT file_name, file_hash FROM audio_cache WHERE status IN {known}),
        n AS (SELECT DISTINCT file_name FROM audio_cache WHERE status = 'done'),
        m AS (SELECT s.*, CASE WHEN duration_ms < 500 OR duration_ms > 30000 THEN 'skipped' WHEN k.file_name IS NOT NULL THEN 'cached'
                     WHEN n.file_name IS NOT NULL THEN 'changed' ELSE 'new' END AS scan_status
              FROM scan_manifest s LEFT JOIN k ON s.file_name = k.file_name AND s.file_hash = k.file_hash LEFT JOIN n ON s.file_name = n.file_name)
    """


UPSERT = (
    classified()
    + """, i AS (
        SELECT * FROM (SELECT file_name, file_hash, file_path, file_size, duration_ms, source_dir,
               row_number() OVER (PARTITION BY file_name, file_hash ORDER BY source_dir DESC NULLS LAST, file_path DESC NULLS LAST, file_size DESC NULLS LAST, duration_ms DESC NULLS LAST) AS k
               FROM m WHERE scan_status IN ('new', 'changed')) WHERE k = 1),
    b AS (SELECT c.id, coalesce(c.file_name, i.file_name) AS file_name, coalesce(c.file_hash, i.file_hash) AS file_hash, i.file_name IS NOT NULL AS hit,
                 CASE WHEN i.file_name IS NOT NULL THEN i.file_path ELSE c.file_path END AS file_path, CASE WHEN i.file_name IS NOT NULL THEN i.file_size ELSE c.file_size END AS file_size,
                 CASE WHEN i.file_name IS NOT NULL THEN i.duration_ms ELSE c.duration_ms END AS duration_ms, CASE WHEN i.file_name IS NOT NULL THEN 'pending' ELSE c.status END AS status,
                 CASE WHEN i.file_name IS NULL THEN c.error_msg END AS error_msg
          FROM audio_cache c FULL JOIN i ON c.file_name = i.file_name AND c.file_hash = i.file_hash)
"""
)

NOTE = "json_extract_string(CAST(body AS JSON), '$.output.choices[0].message.annotations[0].{0}')"
PARSED = f"""
    WITH j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS good FROM asr_response),
    x AS (SELECT *, json_extract(good, '$.output.choices[0].message') AS msg, json_extract(good, '$.output.choices[0].message.content') AS content,
                 json_extract_string(good, '$.output.choices[0].message.annotations[0].emotion') AS e, json_extract_string(good, '$.output.choices[0].message.annotations[0].language') AS l FROM j),
    y AS (SELECT *, coalesce(status_code = 200 AND msg IS NOT NULL AND json_type(msg) = 'OBJECT', false) AS ok FROM x),
    z AS (SELECT response_id, file_name, file_hash, received_at, status_code, body, ok,
        CASE WHEN NOT ok THEN '' ELSE {strip('''coalesce(CASE WHEN json_type(content) = 'ARRAY' THEN array_to_string(list_transform(CAST(content AS JSON[]), lambda p: coalesce(json_extract_string(p, '$.text'), '')), '') ELSE json_extract_string(content, '$') END, '')''')} END AS text,
        CASE WHEN ok AND e IN {EMOTIONS} THEN e ELSE 'neutral' END AS emotion, CASE WHEN ok THEN coalesce(l, '') ELSE '' END AS language, CASE WHEN ok THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM y)
"""

MERGE = """CASE WHEN coalesce(text_emotion, '') = '' THEN 'audio_only' WHEN lower(text_emotion) = lower(emotion) THEN 'both_agree' ELSE 'conflict' END AS source, emotion AS final,
    CASE WHEN coalesce(text_emotion, '') = '' THEN false WHEN lower(text_emotion) = lower(emotion) THEN coalesce(confidence, 0.0) < 0.6 ELSE true END AS needs_review"""

RESOLVED = "coalesce(nullif(emotion_final, ''), nullif(emotion, ''), 'neutral')"


def pcm(factor: float = 1.0) -> str:
    one = f"CAST(trunc(greatest(-32768.0::DOUBLE, least(32767.0::DOUBLE, CAST(x AS DOUBLE) * 32767.0::DOUBLE * {factor}::DOUBLE))) AS INT)"
    return f"SELECT vec_id, list_transform(embedding, lambda x: {one}) AS p FROM embeddings"


# signals as files: every third has two channels, which are mixed down to the floor of their mean
WAVES = f"""WITH s AS ({pcm(2.5)}), w AS (SELECT vec_id, [32000, 44100, 16000, 48000][vec_id % 4 + 1] AS rate, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS channels,
    CASE WHEN vec_id % 3 = 0 THEN list_transform(range(1, len(p), 2), lambda i: CAST(floor((p[i] + p[i + 1]) / 2.0) AS BIGINT)) ELSE p END AS x FROM s)"""
# what the stand-in of an analyser tells of a text by its length
TOLD = """WITH told AS (SELECT id, ['neutral', 'happy', 'sad', 'angry', 'surprised', 'fearful', 'disgusted'][length(asr_text) % 7 + 1] AS t, length(asr_text) % 11 / 10.0::DOUBLE AS s
    FROM audio_cache WHERE status = 'done' AND length(asr_text) > 0) """
PEAK = "coalesce(list_max(list_transform({0}, lambda v: abs(v))), 0)"
SQ = "CAST(coalesce(list_sum(list_transform({0}, lambda v: CAST(v AS BIGINT) * v)), 0) AS BIGINT)"
RMS = f"coalesce(sqrt({SQ}::DOUBLE / nullif(len({{0}}), 0)), 0.0)"
DB = f"20.0::DOUBLE * log10(greatest({RMS} / 32767.0::DOUBLE, 1e-10::DOUBLE))"
CLIP = "len(list_filter({0}, lambda v: abs(v) >= 32111))"
SILENT = "len(list_filter({0}, lambda v: abs(v) < 655.34::DOUBLE))"
CLIPS = f"coalesce({CLIP}::DOUBLE / nullif(len({{0}}), 0), 0.0)"
SILENTS = f"coalesce({SILENT}::DOUBLE / nullif(len({{0}}), 0), 1.0)"
CLIP_OK = f"({CLIPS} < 0.01)"
SILENCE_OK = f"({RMS} / 32767.0::DOUBLE >= 0.01 AND {SILENTS} < 0.8)"
HASH = "md5(array_to_string({0}, ','))"
HOLD = "flatten(list_transform({0}, lambda v: [v, v]))"
MEAN = "list_transform(range(0, len({0}) // 3), lambda i: CAST(floor(list_sum(list_slice({0}, i * 3 + 1, i * 3 + 3))::DOUBLE / 3) AS INT))"
_N = "CAST(floor(len({0}) * 32000.0::DOUBLE / 44100.0::DOUBLE) AS BIGINT)"
_POS = f"(CASE WHEN {_N} > 1 THEN i * (len({{0}}) - 1)::DOUBLE / ({_N} - 1) ELSE 0.0::DOUBLE END)"
LINEAR = (
    f"list_transform(range(0, {_N}), lambda i: CAST(trunc({{0}}[CAST(floor({_POS}) AS BIGINT) + 1]::DOUBLE * (1.0::DOUBLE - ({_POS} - floor({_POS}))) + "
    f"{{0}}[least(CAST(floor({_POS}) AS BIGINT) + 2, len({{0}}))]::DOUBLE * ({_POS} - floor({_POS}))) AS INT))"
)
_scale = lambda x, g: f"list_transform({x}, lambda v: CAST(trunc(greatest(-32768.0::DOUBLE, least(32767.0::DOUBLE, v * {g}))) AS INT))"
LOUD = f"(CASE WHEN {repr(0.707 * 32767)}::DOUBLE / nullif({PEAK}, 0) NOT BETWEEN 0.95 AND 1.05 THEN {repr(0.707 * 32767)}::DOUBLE / nullif({PEAK}, 0) END)"
DECLIP = f"(CASE WHEN {PEAK} >= 32000 THEN {repr(0.9 * 32767)}::DOUBLE / {PEAK} END)"


def _pcm_sql(factor: float, **columns: str) -> str:
    return f"WITH s AS ({pcm(factor)}) SELECT vec_id, " + ", ".join(f"{e.replace('{0}', 'p')} AS {c}" for c, e in columns.items()) + " FROM s"


def _verdict(factor: float, rate: int) -> str:
    f = lambda e: e.replace("{0}", "p")
    rate_msg = f"'采样率 {rate}Hz (需要 32000Hz)'" if rate != 32000 else "NULL"
    clip = f"CASE WHEN NOT {f(CLIP_OK)} THEN '削波率 ' || {_one(f(CLIPS) + ' * 100')} || '% (' || {f(CLIP)} || '/' || len(p) || ' 样本)' END"
    low = f"CASE WHEN {f(RMS)} / 32767.0::DOUBLE < 0.01 THEN 'RMS 过低 (' || {_whole(f(DB))} || ' dB)' END"
    long = f"CASE WHEN {f(SILENTS)} >= 0.8 THEN '静音占比过高 (' || {_whole(f(SILENTS) + ' * 100')} || '%)' END"
    silence = f"CASE WHEN NOT {f(SILENCE_OK)} THEN concat_ws('; ', {low}, {long}) END"
    return f"WITH s AS ({pcm(factor)}) SELECT vec_id, {f(CLIP_OK)} AND {f(SILENCE_OK)} AS passed, concat_ws('; ', {rate_msg}, {clip}, {silence}) AS issues FROM s"


def _fixed(steps: list[tuple[str, str]], factor: float, columns: str) -> str:
    """Applies gain steps one after another."""
    sql, at = f"WITH s0 AS ({pcm(factor)})", 0
    for resampled, gain in steps:
        at += 1
        p = resampled.replace("{0}", "p") if resampled else "p"
        sql += f", r{at} AS (SELECT vec_id, {p} AS p FROM s{at - 1}), g{at} AS (SELECT vec_id, p, {gain.replace('{0}', 'p')} AS g FROM r{at}), s{at} AS (SELECT vec_id, g, CASE WHEN g IS NULL THEN p ELSE {_scale('p', 'g')} END AS p FROM g{at})"
    return f"{sql} SELECT vec_id, {columns} FROM s{at}"


def oracle_sql() -> dict[str, str]:
    gate = "CASE WHEN duration_ms < 500 THEN 'short' WHEN duration_ms > 30000 THEN 'long' ELSE 'ok' END"
    seconds = _one("duration_ms / 1000")
    warning = f"""
        SELECT file_name, '[采样率] ' || file_name || ': 采样率 ' || sr_actual || 'Hz (需要 32000Hz)' AS warning FROM scan_manifest WHERE NOT sr_ok AND sr_actual IS NOT NULL
        UNION ALL SELECT file_name, '[太短] ' || file_name || ': ' || {_whole('duration_ms')} || 'ms (最低 500ms)' FROM scan_manifest WHERE duration_ms < 500
        UNION ALL SELECT file_name, '[太长] ' || file_name || ': ' || {seconds} || 's (最大 30s)' FROM scan_manifest WHERE duration_ms > 30000"""
    audio = "('.wav','.mp3','.flac','.m4a','.ogg','.wma','.aac','.opus')"
    mime = f"CASE {_suffix('file_name')} WHEN '.mp3' THEN 'audio/mpeg' WHEN '.flac' THEN 'audio/flac' WHEN '.m4a' THEN 'audio/mp4' WHEN '.ogg' THEN 'audio/ogg' WHEN '.opus' THEN 'audio/ogg' WHEN '.aac' THEN 'audio/aac' ELSE 'audio/wav' END"
    results = (
        PARSED
        + """, o AS (SELECT *, ok AND text <> '' AS fine, CASE WHEN ok THEN 'empty transcription' WHEN status_code = 200 THEN 'no choices in response'
            ELSE coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.message'), 'status ' || coalesce(CAST(status_code AS VARCHAR), '?')) END AS why FROM z),
        b AS (SELECT file_name, file_hash, arg_min({'fine': fine, 'text': text, 'emotion': emotion, 'language': language, 'confidence': confidence, 'why': why}, {'a': CASE WHEN fine THEN 0 ELSE 1 END, 'b': received_at, 'c': response_id}) AS r FROM o GROUP BY ALL)
        SELECT id, CASE WHEN r IS NULL THEN c.status WHEN r.fine THEN 'done' ELSE 'error' END AS status, CASE WHEN r.fine THEN r.text ELSE asr_text END AS asr_text, CASE WHEN r.fine THEN r.emotion ELSE c.emotion END AS emotion,
            CASE WHEN r.fine THEN r.language ELSE c.language END AS language, CASE WHEN r.fine THEN r.confidence ELSE c.confidence END AS confidence,
            CASE WHEN NOT r.fine THEN r.why ELSE error_msg END AS error_msg, CASE WHEN r.fine THEN '' ELSE raw_asr_text END AS raw_asr_text, CASE WHEN r.fine THEN '[]' ELSE quality_issues END AS quality_issues
        FROM audio_cache c LEFT JOIN b ON c.file_name = b.file_name AND c.file_hash = b.file_hash"""
    )
    return {
        "text_kana": _text(kana(HEARD)),
        "text_fullwidth": _text(wide(HEARD)),
        "text_whitespace": _text(blanks(HEARD)),
        "text_control": _text(control(HEARD)),
        "text_strip": _text(strip(HEARD)),
        "text_normalize": _text(normal(HEARD)),
        "text_nonverbal": _text(sound(strip(HEARD))),
        "text_has_japanese": _text(japanese(HEARD)),
        "text_filler": _text(f"{bare(HEARD)} = '' OR {bare(HEARD)} IN ({_fillers})"),
        "text_filter_reason": _text(reason(normal(HEARD))),
        "text_pipe_escape": _text(f"replace({HEARD}, '|', ' ')"),
        "text_preview": "SELECT id, left(coalesce(nullif(asr_text, ''), nullif(error_msg, ''), ''), 60) AS preview, left(coalesce(nullif(asr_text, ''), nullif(error_msg, ''), '(空)'), 40) AS short FROM audio_cache",
        "postprocess_rows": POST + "SELECT id, status, new_status, CASE WHEN NOT blank THEN new_text END AS new_text, filter_reason, changed FROM p",
        "postprocess_stats": POST
        + """SELECT count(*) AS total, count(*) FILTER (changed) AS normalized, count(*) FILTER (NOT changed AND new_status <> status) AS filtered, count(*) FILTER (NOT blank AND NOT changed AND new_status = status) AS unchanged,
            count(*) FILTER (new_status <> status AND new_status = 'filtered') AS newly_filtered, count(*) FILTER (new_status <> status AND new_status = 'done') AS restored FROM p""",
        "postprocess_apply": POST
        + """SELECT c.id, coalesce(new_status, c.status) AS status, CASE WHEN changed THEN new_text ELSE asr_text END AS asr_text,
            CASE WHEN changed THEN coalesce(nullif(raw_asr_text, ''), asr_text) ELSE raw_asr_text END AS raw_asr_text, filter_reason FROM audio_cache c LEFT JOIN p ON c.id = p.id""",
        "filter_reasons": POST + "SELECT filter_reason, count(*) AS n FROM p WHERE filter_reason <> '' GROUP BY 1",
        "status_counts": f"SELECT count(*) AS total, {_counts} FROM audio_cache",
        "status_counts_by_dir": f"SELECT source_dir, count(*) AS total, {_counts} FROM audio_cache GROUP BY 1",
        "status_histogram": "SELECT status, count(*) AS n FROM audio_cache GROUP BY 1",
        "dashboard": f"SELECT {_dash} FROM audio_cache",
        "dashboard_by_dir": f"SELECT {DIR} AS dir, {_dash} FROM audio_cache GROUP BY 1",
        "emotion_histogram": HISTOGRAM + "SELECT emotion, n FROM h",
        "emotion_share": HISTOGRAM + f"SELECT emotion, n, {_pct('n', 'total')} AS share FROM h",
        "emotion_bar": HISTOGRAM + "SELECT emotion, n, repeat('█', CAST(floor(n / most * 20) AS INT)) || repeat('░', 20 - CAST(floor(n / most * 20) AS INT)) AS bar FROM h",
        "emotion_by_dir": f"SELECT {DIR} AS dir, {label_sql('emotion')} AS emotion, count(*) AS n FROM audio_cache WHERE status = 'done' GROUP BY ALL",
        "neutral_alert": "SELECT count(*) AS done, count(*) FILTER (emotion = 'neutral') AS neutral, coalesce(count(*) FILTER (emotion = 'neutral') * 100.0 / nullif(count(*), 0) > 70, false) AS alert FROM audio_cache WHERE status = 'done'",
        "neutral_alert_by_dir": f"SELECT {DIR} AS dir, count(*) AS done, count(*) FILTER (emotion = 'neutral') AS neutral, coalesce(count(*) FILTER (emotion = 'neutral') * 100.0 / nullif(count(*), 0) > 70, false) AS alert FROM audio_cache WHERE status = 'done' GROUP BY 1",
        "reason_rollup": f"""
            WITH r AS (SELECT id, status, quality_issues, {_json_list('quality_issues')} AS parsed FROM audio_cache WHERE status IN ('filtered', 'error')),
            e AS (SELECT id, unnest(CASE WHEN status = 'error' THEN ['API 错误'] WHEN {ISSUES} THEN list_transform(list_filter(coalesce(parsed, [quality_issues]), lambda x: x IS NOT NULL), lambda x: {_short('x')}) ELSE ['语气词/噪声过滤'] END) AS reason FROM r)
            SELECT reason, count(*) AS n, min(id) AS first_id FROM e GROUP BY 1""",
        "issue_rollup": f"WITH e AS (SELECT unnest({_json_list('quality_issues')}) AS issue FROM audio_cache WHERE {ISSUES}) SELECT {_short('issue')} AS kind, count(*) AS n FROM e WHERE issue IS NOT NULL GROUP BY 1",
        "issue_rows": f"SELECT id, file_name, quality_issues FROM audio_cache WHERE {ISSUES}",
        "issue_count": f"SELECT count(*) AS n FROM audio_cache WHERE {ISSUES}",
        "corrected_count": "SELECT count(*) AS n FROM audio_cache WHERE raw_asr_text <> ''",
        "files_page": "SELECT * EXCLUDE (asr_raw) FROM audio_cache WHERE status = 'done' AND source_dir = '/data/studio_a' ORDER BY id LIMIT 500 OFFSET 100",
        "files_total": "SELECT count(*) AS total FROM audio_cache WHERE status = 'done' AND source_dir = '/data/studio_a'",
        "review_top_n": "SELECT id, file_name, status, quality_issues, left(coalesce(nullif(asr_text, ''), nullif(error_msg, ''), ''), 60) AS preview FROM audio_cache WHERE status IN ('filtered', 'error') ORDER BY id LIMIT 50",
        "review_total": "SELECT count(*) AS n FROM audio_cache WHERE status IN ('filtered', 'error')",
        "done_rows": "SELECT id, file_name, source_dir, coalesce(json_valid(asr_raw), false) AS has_response FROM audio_cache WHERE status = 'done'",
        "done_by_dir": "SELECT source_dir, count(*) AS done, round(sum(duration_ms), 2) AS duration_ms FROM audio_cache WHERE status = 'done' GROUP BY 1",
        "missing_duration": "SELECT id, file_path FROM audio_cache WHERE duration_ms IS NULL",
        "registry_left_stats": f"""
            WITH c AS (SELECT {DIR} AS dir_path, count(*) AS total, {_counts} FROM audio_cache GROUP BY 1)
            SELECT dir_id, r.dir_path, speaker_name, coalesce(total, 0) AS total, {', '.join(f'coalesce({s}, 0) AS {s}' for s in STATUSES)} FROM dir_registry r LEFT JOIN c ON r.dir_path = c.dir_path""",
        "duration_gate": f"SELECT scan_id, {gate} AS gate FROM scan_manifest",
        "duration_messages": f"""SELECT scan_id, CASE WHEN duration_ms < 500 THEN 'duration too short: ' || {_whole('duration_ms')} || 'ms < 500ms' ELSE 'duration too long: ' || {seconds} || 's > 30s' END AS message
            FROM scan_manifest WHERE duration_ms < 500 OR duration_ms > 30000""",
        "scan_classify_per_directory": f"""
            WITH a AS (SELECT file_name, file_hash, status, {DIR} AS d FROM audio_cache), s AS (SELECT *, {DIR} AS d FROM scan_manifest)
            SELECT scan_id, CASE WHEN duration_ms < 500 OR duration_ms > 30000 THEN 'skipped'
                WHEN EXISTS (SELECT 1 FROM a WHERE a.file_name = s.file_name AND a.file_hash = s.file_hash AND a.d = s.d AND a.status IN ('done', 'filtered')) THEN 'cached'
                WHEN EXISTS (SELECT 1 FROM a WHERE a.file_name = s.file_name AND a.d = s.d AND a.status = 'done') THEN 'changed' ELSE 'new' END AS scan_status FROM s""",
        "scan_classify": classified() + "SELECT scan_id, scan_status FROM m",
        "scan_classify_strict": classified(True) + "SELECT scan_id, scan_status FROM m",
        "scan_summary": classified() + f"SELECT batch_no, count(*) AS total, {', '.join(f'''count(*) FILTER (scan_status = '{s}') AS {s}''' for s in ('cached', 'new', 'changed', 'skipped'))} FROM m GROUP BY 1",
        "scan_warnings": f"SELECT warning, count(*) AS n FROM ({warning}) GROUP BY 1",
        "first_warnings": f"WITH w AS ({warning}) SELECT *, (SELECT greatest(count(*) - 10, 0) FROM w) AS left FROM w ORDER BY file_name, warning LIMIT 10",
        "rate_gate": f"SELECT scan_id, '采样率 ' || sr_actual || 'Hz (需要 32000Hz)' AS message FROM scan_manifest WHERE {_suffix('file_name')} = '.wav' AND sr_actual <> 32000",
        "audio_suffix_filter": f"SELECT scan_id, {_suffix('file_path')} IN {audio} AS is_audio FROM scan_manifest",
        "upsert_pending": UPSERT
        + """SELECT coalesce(id, (SELECT max(id) FROM audio_cache) + row_number() OVER (PARTITION BY id IS NULL ORDER BY encode(file_path), encode(file_name), file_hash)) AS id, file_name, file_hash, file_path, file_size, duration_ms, status, error_msg FROM b""",
        "upsert_counts": UPSERT + f"SELECT count(*) AS total, {_counts} FROM b",
        "write_back_results": results,
        "reset_errors": "SELECT id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'error' THEN error_msg END AS error_msg FROM audio_cache",
        "reset_errors_count": "SELECT count(*) AS n FROM audio_cache WHERE status = 'error'",
        "mark_processing": "SELECT id, CASE WHEN status = 'pending' THEN 'processing' ELSE status END AS status FROM audio_cache",
        "backfill_duration": "SELECT id, coalesce(c.duration_ms, m.d) AS duration_ms FROM audio_cache c LEFT JOIN (SELECT file_name, file_hash, max(duration_ms) AS d FROM scan_manifest GROUP BY ALL) m ON c.file_name = m.file_name AND c.file_hash = m.file_hash",
        "backfill_source_dir": """
            WITH f AS (SELECT id, arg_max(dir_path, length(dir_path)) AS d FROM audio_cache c JOIN dir_registry r ON starts_with(c.file_path, r.dir_path || '/') WHERE coalesce(source_dir, '') = '' GROUP BY 1)
            SELECT c.id, coalesce(nullif(source_dir, ''), d, source_dir) AS source_dir FROM audio_cache c LEFT JOIN f ON c.id = f.id""",
        "rename_keys": r"""SELECT id, CASE WHEN w THEN file_name ELSE regexp_replace(file_name, '\.[^./]+$', '.wav') END AS file_name, CASE WHEN w THEN file_hash ELSE md5('wav:' || file_hash) END AS file_hash,
            CASE WHEN w THEN file_path ELSE regexp_replace(file_path, '\.[^./]+$', '.wav') END AS file_path FROM (SELECT *, lower(file_name) LIKE '%.wav' AS w FROM audio_cache)""",
        "pending_paths": "SELECT id, file_path, source_dir FROM audio_cache WHERE status = 'pending'",
        "pending_listed": "SELECT id, file_path FROM audio_cache WHERE status = 'pending' AND file_path IN (SELECT file_path FROM scan_manifest)",
        "clear_count": "SELECT count(*) AS deleted FROM audio_cache",
        "asr_response_parse": PARSED + "SELECT response_id, file_name, file_hash, received_at, ok, text, emotion, language, confidence FROM z",
        "enum_clamp": f"SELECT id, CASE WHEN emotion IN {EMOTIONS} THEN emotion ELSE 'neutral' END AS emotion FROM audio_cache",
        "emotion_resolve": f"SELECT id, {RESOLVED} AS emotion FROM audio_cache",
        "emotion_merge": f"SELECT id, {MERGE} FROM audio_cache WHERE emotion IS NOT NULL",
        "set_emotion_final": "SELECT id, CASE WHEN status = 'done' AND emotion IS NOT NULL THEN emotion ELSE emotion_final END AS emotion_final FROM audio_cache",
        "pcm_peak": _pcm_sql(1.0, peak=PEAK, samples="len({0})"),
        "pcm_rms_db": _pcm_sql(1.0, sum_squares=SQ, rms=f"round({RMS}, 4)", rms_db=f"round({DB}, 4)"),
        "pcm_clipping": _pcm_sql(2.5, clipped=CLIP, share=f"round({CLIPS}, 6)", ok=CLIP_OK),
        "pcm_silence": _pcm_sql(0.05, silent=SILENT, share=f"round({SILENTS}, 6)", ok=SILENCE_OK),
        "pcm_quality_verdict": _verdict(2.5, 44100),
        "pcm_quiet_verdict": _verdict(0.01, 32000),
        "pcm_resample_hold": _pcm_sql(1.0, samples=f"len({HOLD})", signal=HASH.replace("{0}", HOLD)),
        "pcm_resample_mean": _pcm_sql(1.0, samples=f"len({MEAN})", signal=HASH.replace("{0}", MEAN)),
        "pcm_resample_linear": _pcm_sql(1.0, samples=f"len({LINEAR})", signal=HASH.replace("{0}", LINEAR)),
        "pcm_loudness": _fixed([("", LOUD)], 1.0, f"round(g, 6) AS gain, {PEAK.replace('{0}', 'p')} AS peak, {HASH.replace('{0}', 'p')} AS signal"),
        "pcm_declip": _fixed([("", DECLIP)], 2.5, f"round(g, 6) AS gain, {PEAK.replace('{0}', 'p')} AS peak, {HASH.replace('{0}', 'p')} AS signal"),
        "pcm_auto_fix": _fixed([(HOLD, LOUD), ("", DECLIP)], 1.0, f"len(p) AS samples, {HASH.replace('{0}', 'p')} AS signal"),
        "mime_data_uri": f"SELECT id, 'data:' || {mime} || ';base64,' || to_base64(encode(coalesce(asr_text, file_hash))) AS uri FROM audio_cache",
        "content_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "next_version": r"SELECT coalesce(max(CAST(regexp_extract(name, '^v(\d+)$', 1) AS BIGINT)), 0) + 1 AS next_version FROM (SELECT 'v' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.bak' ELSE '' END AS name FROM documents) WHERE regexp_matches(name, '^v(\d+)$')",
        "export_written": "SELECT unnest(regexp_split_to_array(coalesce(file_path, '') || '|heroine|ja|' || replace(coalesce(asr_text, ''), '|', ' '), '\\r\\n|\\n|\\r')) AS line FROM audio_cache WHERE status = 'done'",
        "progress_events": """SELECT id, 'event: progress' || chr(10) || 'data: {"id":' || id || ',"status":"' || CASE WHEN status = 'error' THEN 'error' ELSE 'ok' END || '"}' || chr(10) || chr(10) AS event
            FROM audio_cache WHERE status IN ('done', 'error', 'filtered')""",
        "wav_probe": f"""{WAVES} SELECT vec_id, true AS readable, rate AS sample_rate, channels, len(x) AS frames, round(len(x) / rate::DOUBLE * 1000, 6) AS duration_ms, {PEAK.replace('{0}', 'x')} AS peak, {SQ.replace('{0}', 'x')} AS sum_squares,
            len(list_filter(x, lambda v: abs(v) >= 32111)) AS clipped, len(list_filter(x, lambda v: abs(v) < 655.34)) AS silent FROM w""",
        "wav_manifest": f"""{WAVES} SELECT 's' || vec_id || '.wav' AS file_name, '/signals/' || vec_id % 7 || '/s' || vec_id || '.wav' AS file_path, 44 + 128 AS file_size, round(len(x) / rate::DOUBLE * 1000, 6) AS duration_ms,
            '/signals/' || vec_id % 7 AS source_dir, rate = 32000 AS sr_ok, rate AS sr_actual FROM w""",
        "wav_repair": f"""WITH s AS ({pcm(1.0)}), k AS (SELECT *, {PEAK.replace('{0}', 'p')} AS k FROM s)
            SELECT '/signals/' || vec_id % 7 || '/s' || vec_id || '.wav' AS file_path, true AS readable, 16000 AS orig_rate, true AS rate_fixed, k > 0 AND 0.707 * 32767 / nullif(k, 0) NOT BETWEEN 0.95 AND 1.05 AS loudness_fixed,
            false AS clipping_fixed, true AS any_fixed FROM k""",
        "wav_repaired": _fixed([(HOLD, LOUD), ("", DECLIP)], 1.0, f"len(p) AS samples, {HASH.replace('{0}', 'p')} AS signal"),
        "convert_probe": f"{WAVES} SELECT vec_id, rate AS sample_rate, channels, 'pcm_s16le' AS format, round(len(x) / rate::DOUBLE * 1000, 6) AS duration_ms, rate <> 32000 OR channels > 1 AS fixed FROM w",
        "convert_written": f"{WAVES}, n AS (SELECT vec_id, CASE rate WHEN 32000 THEN len(x) WHEN 16000 THEN 2 * len(x) ELSE trunc(len(x) * 32000::DOUBLE / rate) END AS n FROM w) SELECT vec_id, 32000 AS sample_rate, 1 AS channels, round(n / 32000::DOUBLE * 1000, 6) AS duration_ms FROM n",
        "transcribe_files": """WITH e AS (SELECT vec_id AS i, ['neutral', 'happy', 'sad', 'angry', 'surprised', 'fearful', 'disgusted'] AS names, CASE WHEN vec_id % 7 = 0 THEN 'slow down' WHEN vec_id % 5 = 0 THEN 'empty transcription' END AS why FROM embeddings)
            SELECT 's' || i AS file_name, md5(CAST(i AS VARCHAR)) AS file_hash, CASE WHEN why IS NULL THEN 'done' ELSE 'error' END AS status, CASE WHEN why IS NULL THEN '声' || i END AS asr_text,
            CASE WHEN why IS NULL THEN CASE WHEN i % 3 = 0 THEN 'neutral' ELSE names[i % 7 + 1] END END AS emotion, CASE WHEN why IS NULL THEN CASE WHEN i % 2 = 1 THEN 'ja' ELSE 'en' END END AS language,
            CASE WHEN why IS NULL THEN 0.9::DOUBLE END AS confidence, why AS error_msg FROM e""",
        "text_emotions": TOLD + "SELECT id, t AS text_emotion, s AS text_confidence, CAST(NULL AS VARCHAR) AS text_error FROM told",
        "text_emotions_merged": TOLD + "SELECT c.id, coalesce(t, c.text_emotion) AS text_emotion, CASE WHEN t IS NOT NULL THEN emotion ELSE emotion_final END AS emotion_final FROM audio_cache c LEFT JOIN told ON c.id = told.id",
        "snapshot_of_directory": f"SELECT id, file_name, status, asr_text FROM audio_cache WHERE {DIR} = '/data/studio_a'",
        "ingest_twice": UPSERT
        + """, g AS (SELECT DISTINCT file_name, file_hash FROM m WHERE scan_status = 'skipped' EXCEPT SELECT file_name, file_hash FROM b)
            SELECT file_name, file_hash, status, error_msg FROM b UNION ALL SELECT file_name, file_hash, 'filtered', NULL FROM g""",
        "export_list_lines": "SELECT id, coalesce(file_path, '') || '|heroine|ja|' || replace(coalesce(asr_text, ''), '|', ' ') AS line FROM audio_cache WHERE status = 'done'",
        "export_annotations": f"""SELECT id, {RESOLVED} || '/' || file_name AS file, file_path AS original_path, replace(coalesce(asr_text, ''), '|', ' ') AS text, coalesce(nullif(language, ''), 'ja') AS language, emotion AS audio,
            text_emotion AS text_semantic, {RESOLVED} AS final, confidence, round(duration_ms, 3) AS duration_ms, file_hash, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS processed_at FROM audio_cache WHERE status = 'done'""",
        "export_emotion_counts": f"SELECT {RESOLVED} AS emotion, count(*) AS n FROM audio_cache WHERE status = 'done' GROUP BY 1",
        "export_latest": "SELECT max(id) AS id FROM audio_cache WHERE status = 'done' GROUP BY source_dir, file_name",
        "progress_percent": f"SELECT {DIR} AS dir, count(*) AS total, count(*) FILTER (status IN ('done', 'filtered', 'error')) AS finished, {_pct('''count(*) FILTER (status IN ('done', 'filtered', 'error'))''', 'count(*)')} AS percent FROM audio_cache GROUP BY 1",
    }
