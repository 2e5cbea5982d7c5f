"""SQL of the chapter projection, written from its definition for the checking engine. It shares no code with the DataFrame operator; only the lexicon is the same data."""

from __future__ import annotations

from storyloom.functions.lexicon import LATIN, LexiconPack

CHAPTERS = """
SELECT source AS book, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS ch_num
FROM documents
"""
SAG_EVENTS = """
SELECT event_id, CAST(floor(event_id / 40) + 1 AS BIGINT) AS chapter_id, user_id, event_type, value, CAST(floor(value) % 10 + 1 AS BIGINT) AS importance, CAST(props->>'$.k' AS BIGINT) AS k,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS related_id
FROM events
"""
ENTITY_EVENT = """
SELECT 'u' || user_id AS entity, event_id, chapter_id, event_type, importance FROM sag_events
UNION ALL SELECT 'k' || k, event_id, chapter_id, event_type, importance FROM sag_events WHERE k IS NOT NULL
"""
S = r" \t\n\r\f\x{0B}"


def parts_sql(text: str, pattern: str) -> str:
    """The trimmed parts between matches of a pattern that are not empty."""
    return f"list_filter(list_transform(regexp_split_to_array({text}, '{pattern}'), lambda x: regexp_replace(x, '^[{S}]+|[{S}]+$', '', 'g')), lambda x: x <> '')"


def paragraphs_sql(text: str, chars: str) -> str:
    blocks = parts_sql(text, rf"\n[{S}]*\n")
    return f"CASE WHEN len({blocks}) < greatest(1, {chars} / 200.0) THEN {parts_sql(text, chr(92) + 'n')} ELSE {blocks} END"


def sentence_sql(ends: str) -> str:
    return rf"[^{S}{ends}]([^{ends}]*[^{S}{ends}])?"


def metrics_sql(pack: LexiconPack = LATIN) -> str:
    """One row per chapter: counts, densities, classes. Rounded as the domain reports them."""
    names = list(pack.pleasure)
    n_of = lambda text, p: f"CAST(len(regexp_extract_all({text}, '{p}')) AS BIGINT)"
    chars_of = lambda text, p: f"CAST(length({text}) - length(regexp_replace({text}, '{p}', '', 'g')) AS BIGINT)"
    counts = ",\n ".join(f"{n_of('low', e.pattern)} AS {n}_count" for n, e in pack.pleasure.items())
    weighted = " + ".join([f"{n}_count * {e.weight}e0" for n, e in pack.pleasure.items()] + [f"general_count * {pack.general.weight}e0", f"physio_count * {pack.physio.weight}e0"])
    conflicts = " + ".join(n_of("low", p) for p in pack.conflict.values())
    top = f"greatest({', '.join(f'{n}_count' for n in names)})"
    dominant = "CASE " + " ".join(f"WHEN {n}_count = {top} THEN '{e.label or n}'" for n, e in pack.pleasure.items()) + " END"
    delayed = ", ".join(f"'{e.label or n}'" for n, e in pack.pleasure.items() if e.timing == "delayed")
    hooks = ""
    for h in pack.hooks:
        fires = [f"regexp_matches(right(low, {n}), '{p}')" for n, p in h.rules]
        if h.short_last:
            fires.append("(len(ending) >= 2 AND length(ending[-1]) < 30 AND length(ending[-2]) > 80)")
        hooks += f" WHEN {' OR '.join(fires)} THEN '{h.label}'"
    delight, tension, tragedy, suspense, daily = pack.emotions
    sentence = sentence_sql(pack.ends)
    return f"""
SELECT book, doc_id, ch_num, ch_hash, wc, para_count, CAST(floor(para_len) AS BIGINT) AS avg_para_len, round(talk, 3) AS dialogue_ratio, round(excl, 2) AS excl_density,
  round(pos, 2) AS pos_density, round(neg, 2) AS neg_density, round(conf, 2) AS conflict_density, round(hook, 2) AS hook_density,
  {", ".join(f"{n}_count" for n in names)}, physio_count, dominant_sub,
  CASE WHEN pleasure_intensity >= 6 THEN 'climax' WHEN pleasure_intensity >= 4 THEN 'major' WHEN pleasure_intensity >= 2 THEN 'minor' ELSE 'none' END AS pleasure_type, pleasure_intensity,
  CASE WHEN dominant_sub IN ({delayed}) THEN 'delayed' ELSE 'instant' END AS pleasure_timing, hook_type,
  round(least(greatest(asl / 80 * 0.5e0 + (1 - vd * 3) * 0.3e0 + abs(asl - 35) / 50 * 0.2e0, 0e0), 1e0), 3) AS readability, round(asl, 1) AS avg_sentence_len, round(vd, 3) AS vocab_diversity,
  conf > 0.3e0 AS conflict, CASE WHEN conf > 2.5e0 THEN 'high' WHEN conf > 1 THEN 'medium' WHEN conf > 0.3e0 THEN 'low' ELSE 'none' END AS conflict_level,
  CASE WHEN pos > neg * 2 THEN '{delight}' WHEN conf > 2 AND neg > pos THEN '{tension}' WHEN sacrifice_count >= 2 AND bond_count >= 2 THEN '{tragedy}' WHEN conf > 1.5e0 THEN '{tragedy}' WHEN comeback_count > slap_count THEN '{suspense}' ELSE '{daily}' END AS emotion,
  CASE WHEN para_len < 45 OR (para_len < 80 AND excl > 0.5e0) THEN 'fast' WHEN para_len > 250 THEN 'slow' ELSE 'medium' END AS pace,
  anti_trope_count > 0 AS anti_trope, anti_trope_count,
  CAST(least(10, greatest(-10, high_emotion_count * 3 + physio_count * 2 - low_emotion_count * 2 - burnout_count * 4)) AS BIGINT) AS emotion_valence,
  high_emotion_count >= 2 AND burnout_count >= 1 AS emotion_burnout, high_emotion_count, burnout_count, slap_count > 5 AND pleasure_intensity < 3 AS slap_noise
FROM (
  SELECT *, round(least(10e0, greatest(0e0, 0.7e0 * (2 * pos + 1.5e0 * conf + 0.5e0 * excl + 0.5e0 * hook + 0.2e0 * neg + 2e0 * physio_count / greatest(wc / 100e0, 1e0)))), 1) AS pleasure_intensity
  FROM (
    SELECT *, 100e0 * ({weighted}) / greatest(wc, 1) AS pos, 100e0 * negatives / greatest(wc, 1) AS neg, 100e0 * conflicts / greatest(wc, 1) AS conf, 100e0 * exclamations / greatest(wc, 1) AS excl,
      hooks / greatest(wc / 1000e0, 1e0) AS hook, dialogue_chars / greatest(wc, 1) AS talk, wc / greatest(para_count, 1) AS para_len, sentence_chars / greatest(sentences, 1) AS asl, distinct_chars / greatest(wc, 1) AS vd, {dominant} AS dominant_sub
    FROM (
      SELECT book, doc_id, ch_num, substr(sha256(text), 1, 16) AS ch_hash, wc, CAST(len({paragraphs_sql("text", "wc")}) AS BIGINT) AS para_count,
        {chars_of("text", pack.dialogue)} AS dialogue_chars, {n_of("text", pack.exclamation)} AS exclamations,
        {counts},
        {n_of("low", pack.general.pattern)} AS general_count, {n_of("low", pack.physio.pattern)} AS physio_count, {n_of("low", pack.negative)} AS negatives, {conflicts} AS conflicts, {n_of("low", pack.hook)} AS hooks,
        CASE{hooks} ELSE 'none' END AS hook_type, {n_of("text", sentence)} AS sentences, {chars_of("text", sentence)} AS sentence_chars,
        len(list_distinct(list_filter(string_split(translate(text, chr(10) || ' ', ''), ''), lambda x: x <> ''))) AS distinct_chars,
        {n_of("low", pack.anti_trope)} AS anti_trope_count, {n_of("low", pack.high_emotion)} AS high_emotion_count, {n_of("low", pack.low_emotion)} AS low_emotion_count, {n_of("low", pack.burnout)} AS burnout_count
      FROM (
        SELECT *, {"lower(text)" if pack.lower else "text"} AS low, CAST(length(translate(text, chr(10) || ' ', '')) AS BIGINT) AS wc, {paragraphs_sql("right(text, 500)", "length(right(text, 500))")} AS ending
        FROM (SELECT source AS book, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS ch_num, coalesce(text, '') AS text FROM documents) a
      ) b
    ) c
  ) d
) e
"""
