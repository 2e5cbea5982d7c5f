"""Sequence operators over the chapter metrics and the event table, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.operators import sequence as s
from storyloom.plans.registry import Catalog

query = Catalog()

STREAKS = """
    SELECT book, count(*) AS run, min(ch_num) AS first, max(ch_num) AS last FROM (
      SELECT book, ch_num, ch_num - row_number() OVER (PARTITION BY book ORDER BY ch_num) AS island FROM metrics WHERE {where}) a
    GROUP BY book, island"""


@query("zero_hook_streak", f"SELECT b.book, coalesce(max(s.run), 0) AS max_streak FROM (SELECT DISTINCT book FROM metrics) b LEFT JOIN ({STREAKS.format(where='hook_density < 0.1')}) s ON b.book = s.book GROUP BY b.book")
def _(t):
    return s.longest_run(t.metrics, F.col("hook_density") < 0.1)


@query("low_conflict_runs", f"SELECT * FROM ({STREAKS.format(where='conflict_density < 1')}) s WHERE run >= 2")
def _(t):
    return s.runs(t.metrics, F.col("conflict_density") < 1).where("run >= 2")


#: metrics with n, the values of earlier chapters and ch_variability (0 in the first and the last chapter).
VARIED = """
    SELECT *, CASE WHEN prev_wc IS NULL OR ch_num = n THEN 0e0 ELSE round((abs(wc - prev_wc) / greatest(prev_wc, 1) + abs(dialogue_ratio - prev_dialogue) / greatest(prev_dialogue, 0.001e0)
           + abs(pos_density - prev_pos) / greatest(prev_pos, 0.001e0) + abs(conflict_density - prev_conf) / greatest(prev_conf, 0.001e0)) / 4, 3) END AS ch_variability
    FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n, lag(wc) OVER w AS prev_wc, lag(dialogue_ratio) OVER w AS prev_dialogue, lag(pos_density) OVER w AS prev_pos, lag(conflict_density) OVER w AS prev_conf,
                 lag(conflict_density, 2) OVER w AS prev_conf_2, lag(hook_density) OVER w AS prev_hook, lag(pleasure_intensity) OVER w AS prev_intensity
          FROM metrics WINDOW w AS (PARTITION BY book ORDER BY ch_num)) v"""
LABELLED = f"""
    SELECT book, ch_num, CASE WHEN conflict_density < 0.3 AND pleasure_intensity < 3 THEN 'opening' WHEN conflict_density >= 0.3 AND conflict_density < 1 THEN 'development'
      WHEN ch_variability > 0.5 OR abs(pleasure_intensity - prev_intensity) > 2.5 THEN 'turn' WHEN pleasure_intensity >= 5 THEN 'payoff' WHEN conflict_density > 1.5 AND neg_density > pos_density THEN 'tension'
      WHEN conflict_density < 0.2 AND dialogue_ratio > 0.25 THEN 'relief' WHEN hook_type = 'suspense' AND conflict_density < 0.5 THEN 'clue' WHEN hook_type IN ('reversal', 'info') AND conflict_density < 0.5 THEN 'overturn' ELSE 'development' END AS label
    FROM ({VARIED}) z"""


@query("chapter_variability", f"SELECT book, ch_num, ch_variability FROM ({VARIED}) v")
def _(t):
    return s.variability(t.metrics).select("book", "ch_num", "ch_variability")


@query(
    "pleasure_level",
    """
    SELECT book, ch_num, round(near, 3) AS near_intensity,
           CASE WHEN climax = 1 AND round(near, 6) >= 6 THEN 'large' WHEN major = 1 AND round(near, 6) >= 4 AND slaps >= 3 THEN 'medium' WHEN slaps >= 1 OR pleasure_intensity >= 2 THEN 'small' ELSE 'none' END AS pleasure_level
    FROM (SELECT book, ch_num, pleasure_intensity, avg(pleasure_intensity) OVER w AS near, max(CASE WHEN pleasure_type = 'climax' THEN 1 ELSE 0 END) OVER w AS climax, max(CASE WHEN pleasure_type = 'major' THEN 1 ELSE 0 END) OVER w AS major, sum(slap_count) OVER w AS slaps
          FROM metrics WINDOW w AS (PARTITION BY book ORDER BY ch_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) a""",
)
def _(t):
    return s.pleasure_level(t.metrics).select("book", "ch_num", "near_intensity", "pleasure_level")


@query(
    "verify_sample",
    """
    SELECT book, ch_num FROM (
      SELECT book, ch_num, row_number() OVER (PARTITION BY book ORDER BY ch_num) AS pick FROM (
        SELECT *, count(*) OVER (PARTITION BY book) AS n, row_number() OVER (PARTITION BY book ORDER BY pleasure_intensity DESC, ch_num) AS by_intensity, row_number() OVER (PARTITION BY book ORDER BY conflict_density DESC, ch_num) AS by_conflict FROM metrics) a
      WHERE (ch_num - 1) % greatest(CAST(floor(n / 10) AS BIGINT), 1) = 0 OR ch_num = n OR by_intensity = 1 OR by_conflict = 1) b
    WHERE pick <= 15""",
)
def _(t):
    return s.verify_sample(t.metrics)


CURVE = """
    SELECT book, ch_num, count(*) OVER (PARTITION BY book) AS n, v, a, d, avg(v) OVER (PARTITION BY book ORDER BY ch_num ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS after_v, avg(v) OVER (PARTITION BY book ORDER BY ch_num ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before_v,
           stddev_samp(v) OVER (PARTITION BY book ORDER BY ch_num ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS sd
    FROM (SELECT book, ch_num, round(pos_density - neg_density, 2) AS v, pleasure_intensity AS a, round(10 - conflict_density, 2) AS d FROM metrics) x"""
TURNS = f"""
    SELECT book, ch_num, CASE WHEN after_v > before_v THEN 'up' ELSE 'down' END AS dir, round(round(abs(after_v - before_v), 9), 2) AS delta FROM ({CURVE}) c
    WHERE n >= 10 AND ch_num > 2 AND ch_num <= n - 2 AND sd > 0 AND round(abs(after_v - before_v), 9) > round(1.2 * sd, 9)"""


@query("turning_points", TURNS)
def _(t):
    return s.turning_points(t.metrics)


@query(
    "vad_summary",
    f"""
    SELECT a.book, CASE WHEN n >= 10 THEN round(round(v, 9), 2) ELSE 0e0 END AS v_mean, CASE WHEN n >= 10 THEN round(round(a, 9), 1) ELSE 0e0 END AS a_mean, CASE WHEN n >= 10 THEN round(round(d, 9), 2) ELSE 0e0 END AS d_mean, coalesce(b.turns, 0) AS turning_count
    FROM (SELECT book, avg(v) AS v, avg(a) AS a, avg(d) AS d, count(*) AS n FROM ({CURVE}) c GROUP BY book) a LEFT JOIN (SELECT book, count(*) AS turns FROM ({TURNS}) e GROUP BY book) b ON a.book = b.book""",
)
def _(t):
    return s.vad_summary(t.metrics)


@query(
    "state_trajectory",
    """
    SELECT book, CAST(sum(CASE WHEN round(abs(v - pv), 9) > round(1.5 * sv, 9) OR round(abs(a - pa), 9) > round(1.5 * sa, 9) THEN 1 ELSE 0 END) AS BIGINT) AS change_count,
      round(round(1 - least(1e0, sum(CASE WHEN round(abs(v - pv), 9) > round(1.5 * sv, 9) OR round(abs(a - pa), 9) > round(1.5 * sa, 9) THEN 1 ELSE 0 END) / greatest(max(n) * 0.05e0, 1e0)), 9), 3) AS stability,
      CASE WHEN round(max(v_end) - max(v_start), 9) > 0.02 THEN 'rising' WHEN round(max(v_start) - max(v_end), 9) > 0.02 THEN 'falling' ELSE 'level' END AS arc, max(v_start) AS v_start, max(v_end) AS v_end
    FROM (SELECT *, CASE WHEN k = greatest(5, floor(n / 10)) THEN v END AS v_start, CASE WHEN k = n - greatest(5, floor(n / 10)) + 1 THEN v END AS v_end FROM (
      SELECT book, v, a, lag(v) OVER w AS pv, lag(a) OVER w AS pa, row_number() OVER w AS k, count(*) OVER (PARTITION BY book) AS n, stddev_samp(v) OVER (PARTITION BY book) AS sv, stddev_samp(a) OVER (PARTITION BY book) AS sa
      FROM (SELECT book, ch_num, round(pos_density - neg_density, 3) AS v, pleasure_intensity AS a FROM metrics) x WINDOW w AS (PARTITION BY book ORDER BY ch_num)) y) z
    WHERE n >= 10 GROUP BY book""",
)
def _(t):
    return s.state_trajectory(t.metrics)


@query(
    "arc_phases",
    """
    WITH RECURSIVE c AS (
      SELECT book, pleasure_intensity AS x, pace, dominant_sub AS sub, row_number() OVER (PARTITION BY book ORDER BY ch_num) AS k, count(*) OVER (PARTITION BY book) AS n FROM metrics
    ), f AS (
      SELECT book, k, n, x, pace, CAST(1 AS BIGINT) AS start, sub AS own, false AS ended, CAST(NULL AS BIGINT) AS old_start, CAST(NULL AS VARCHAR) AS old_sub FROM c WHERE k = 1 AND n >= 10
      UNION ALL
      SELECT book, k, n, x, pace, CASE WHEN ends THEN k ELSE start END, CASE WHEN ends THEN sub ELSE own END, ends, start, own FROM (
        SELECT c.book, c.k, c.n, c.x, c.pace, c.sub, f.start, f.own, round(abs(c.x - f.x), 6) > 3 OR (c.pace <> f.pace AND round(abs(c.x - f.x), 6) > 1.5) OR (c.sub <> f.own AND f.own <> 'none' AND c.sub <> 'none' AND f.k - f.start > 5) AS ends
        FROM f JOIN c ON c.book = f.book AND c.k = f.k + 1) g
    ), p AS (
      SELECT book, old_start AS start_ch, k - 1 AS end_ch, old_sub AS dominant_sub FROM f WHERE ended
      UNION ALL SELECT book, start, n, own FROM f WHERE k = n
    )
    SELECT book, row_number() OVER (PARTITION BY book ORDER BY start_ch) AS phase, start_ch, end_ch, dominant_sub, round(least(1e0, count(*) OVER (PARTITION BY book) / 5e0), 2) AS completeness FROM p""",
)
def _(t):
    return s.phases(t.metrics)


@query("plot_transitions", "SELECT book, CAST(coalesce(sum(CASE WHEN dominant_sub <> before_sub THEN 1 ELSE 0 END), 0) AS BIGINT) AS transitions FROM (SELECT book, dominant_sub, lag(dominant_sub) OVER (PARTITION BY book ORDER BY ch_num) AS before_sub FROM metrics) a GROUP BY book")
def _(t):
    return s.transitions(t.metrics)


@query("structure_labels", LABELLED)
def _(t):
    return s.structure_labels(t.metrics)


TEMPLATES = {"seven_steps": s.TEMPLATE, "turned_twice": ("turn", "development", "turn"), "opened_and_turned": ("opening", "turn")}


@query(
    "template_match",
    " UNION ALL ".join(
        f"SELECT '{name}' AS template, book, ch_num FROM (SELECT book, ch_num, {', '.join(f'lead(label, {k}) OVER w AS l{k}' for k in range(len(labels)))} FROM ({LABELLED}) y WINDOW w AS (PARTITION BY book ORDER BY ch_num)) a WHERE {' AND '.join(f'l{k} = {chr(39)}{x}{chr(39)}' for k, x in enumerate(labels))}"
        for name, labels in TEMPLATES.items()
    ),
)
def _(t):
    """The template of seven steps, which the sample tables do not have, and two short ones that they do."""
    found = [s.template_match(s.structure_labels(t.metrics), labels).withColumn("template", F.lit(name)) for name, labels in TEMPLATES.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "risk_events",
    f"""
    SELECT book, ch_num, risk FROM (
      SELECT book, ch_num, risk, row_number() OVER (PARTITION BY book ORDER BY late, ch_num, risk) AS k FROM (
        SELECT book, ch_num, t.risk, t.late
        FROM (SELECT *, min(CASE WHEN flat = 1 THEN ch_num END) OVER (PARTITION BY book) AS first_flat
              FROM (SELECT *, CASE WHEN ch_num < n AND conflict_density < 0.1 AND prev_conf < 0.1 AND prev_conf_2 < 0.1 THEN 1 ELSE 0 END AS flat FROM ({VARIED}) x) y) m
        CROSS JOIN (SELECT 'no_hook_twice' AS risk, 0 AS late UNION ALL SELECT 'rhythm_jump', 0 UNION ALL SELECT 'flat_conflict', 1) t
        WHERE ch_num < n AND ((t.risk = 'no_hook_twice' AND hook_density = 0 AND prev_hook = 0) OR (t.risk = 'rhythm_jump' AND ch_variability > 50) OR (t.risk = 'flat_conflict' AND ch_num = first_flat))) b
      ) c WHERE k <= 10""",
)
def _(t):
    return s.risk_events(t.metrics)


SMOOTH = """
    SELECT book, ch_num, n, round(CASE WHEN n >= 5 THEN near / 5 ELSE v END, 9) AS smoothed
    FROM (SELECT book, ch_num, v, count(*) OVER (PARTITION BY book) AS n, sum(v) OVER (PARTITION BY book ORDER BY ch_num ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near
          FROM (SELECT book, ch_num, conflict_density + 0.5e0 * hook_density AS v FROM metrics) a) b"""


@query("beat_smooth", f"SELECT book, ch_num, round(smoothed, 4) AS smoothed FROM ({SMOOTH}) x")
def _(t):
    return s.smoothed(t.metrics).select("book", "ch_num", F.round("smoothed", 4).alias("smoothed"))


@query(
    "beat_detection",
    f"""
    SELECT book, beat, found_ch, target_ch, confidence, confidence < 0.3 AS is_gap, abs(found_ch - target_ch) > 0.08e0 * n AS is_far, round(avg(CASE WHEN confidence >= 0.5 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY book), 2) AS completeness
    FROM (SELECT book, beat, ch_num AS found_ch, target_ch, n, round(greatest(0e0, 1 - abs(ch_num - target_ch) / reach), 2) AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY book, beat ORDER BY low * smoothed, ch_num) AS k FROM (
        SELECT m.*, t.beat, t.low, CAST(greatest(1, floor(t.place * m.n)) AS BIGINT) AS target_ch, greatest(5e0, floor(0.05e0 * m.n)) AS reach
        FROM ({SMOOTH}) m CROSS JOIN ({" UNION ALL ".join(f"SELECT '{beat}' AS beat, {place}e0 AS place, {1 if beat in ('all_is_lost', 'dark_night') else -1} AS low" for beat, place in s.BEATS)}) t) a
      WHERE ch_num >= target_ch - reach AND ch_num < target_ch + reach) b
    WHERE k = 1) c""",
)
def _(t):
    return s.beat_detection(t.metrics)


@query(
    "emotion_monotony",
    """
    SELECT user_id, ts, event_id, event_type, run FROM (
      SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY ts, event_id) AS run FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) a) b
    WHERE run >= 3""",
)
def _(t):
    return s.repeats(t.events, "event_type", "user_id", ["ts", "event_id"])


@query(
    "growth_stagnation",
    """
    SELECT user_id, n, last_growth, n - coalesce(last_growth, 0) AS stalled FROM (
      SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN k END) AS last_growth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) a GROUP BY user_id) b
    WHERE n - coalesce(last_growth, 0) >= 10""",
)
def _(t):
    return s.stagnation(t.events, F.col("event_type") == "purchase", "user_id", ["ts", "event_id"])


@query(
    "motivation_changes",
    """
    SELECT user_id, CAST(sum(CASE WHEN event_type <> before_type THEN 1 ELSE 0 END) AS BIGINT) AS changes, count(DISTINCT event_type) AS variety
    FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_type FROM events WHERE value > 20) a GROUP BY user_id""",
)
def _(t):
    return s.changes(t.events.where("value > 20"), "event_type", "user_id", ["ts", "event_id"])


@query(
    "foreshadow_decay",
    """
    SELECT event_id, chapter_id, age, CASE WHEN age > 50 AND importance < 9 THEN 'archive' WHEN age > 20 THEN 'warn' ELSE 'open' END AS state
    FROM (SELECT event_id, chapter_id, importance, 120 - chapter_id AS age FROM sag_events WHERE event_type = 'click' AND chapter_id <= 120) a""",
)
def _(t):
    planted = t.sag_events.where("event_type = 'click' AND chapter_id <= 120")
    return s.decay(planted, F.lit(120), "chapter_id", F.col("importance") >= 9).select("event_id", "chapter_id", "age", "state")


@query(
    "context_window",
    """
    SELECT book, ch_num, count(wc) OVER w AS n_before, CAST(coalesce(sum(wc) OVER w, 0) AS BIGINT) AS wc_before, round(avg(pleasure_intensity) OVER w, 3) AS intensity_before, coalesce(string_agg(dominant_sub, ',') OVER w, '') AS subs_before
    FROM metrics WINDOW w AS (PARTITION BY book ORDER BY ch_num ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def _(t):
    return s.context_window(t.metrics)


@query("peak_interval", "SELECT book, count(*) AS n_peaks, round(avg(gap), 3) AS mean_gap FROM (SELECT book, ch_num - lag(ch_num) OVER (PARTITION BY book ORDER BY ch_num) AS gap FROM metrics WHERE pleasure_intensity >= 4) a GROUP BY book")
def _(t):
    return s.peak_interval(t.metrics, F.col("pleasure_intensity") >= 4)


@query("wave_turning", "SELECT book, ch_num, round(pleasure_intensity / prev, 3) AS ratio FROM (SELECT book, ch_num, pleasure_intensity, lag(pleasure_intensity) OVER (PARTITION BY book ORDER BY ch_num) AS prev FROM metrics) a WHERE prev > 0 AND pleasure_intensity / prev > 1.3")
def _(t):
    return s.wave_turning(t.metrics)


@query(
    "adaptive_keyframes",
    """
    WITH typed AS (
      SELECT book, ch_num, hook_type, lag(hook_type) OVER (PARTITION BY book ORDER BY ch_num) AS before_type FROM metrics WHERE hook_type <> 'none'
    )
    SELECT book, ch_num FROM (
      SELECT book, ch_num, row_number() OVER (PARTITION BY book ORDER BY ch_num) AS k FROM (
        SELECT m.*, count(*) OVER (PARTITION BY m.book) AS n, row_number() OVER (PARTITION BY m.book ORDER BY conflict_density DESC, m.ch_num) AS c, row_number() OVER (PARTITION BY m.book ORDER BY pleasure_intensity DESC, m.ch_num) AS i,
               sum(CASE WHEN hook_density < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY m.book ORDER BY m.ch_num) AS hookless, t.before_type IS NOT NULL AND t.before_type <> t.hook_type AS switch
        FROM metrics m LEFT JOIN typed t ON m.book = t.book AND m.ch_num = t.ch_num) a
      WHERE ch_num <= 3 OR c <= 5 OR i <= 3 OR ch_num = n OR (hook_density < 0.1 AND hookless <= 5) OR switch OR list_contains([floor(n * p / 100) + 1 for p in [10, 20, 30, 40, 50, 60, 70, 80, 90]], ch_num)) b
    WHERE k <= 30""",
)
def _(t):
    return s.keyframes(t.metrics)


@query(
    "climax_positions",
    """
    SELECT book, min(CASE WHEN pleasure_intensity > 1.3 * mean THEN ch_num END) AS first_high, min(CASE WHEN pleasure_intensity = top THEN ch_num END) AS climax_ch, max(ch_num) AS n
    FROM (SELECT book, ch_num, pleasure_intensity, avg(pleasure_intensity) OVER (PARTITION BY book) AS mean, max(pleasure_intensity) OVER (PARTITION BY book) AS top FROM metrics) a GROUP BY book""",
)
def _(t):
    return s.climax_positions(t.metrics)


@query(
    "half_trend",
    """
    SELECT book, a AS first_half, b AS second_half, CASE WHEN n < 6 THEN 'unknown' WHEN b > 1.15e0 * a THEN 'rising' WHEN b < 0.85e0 * a THEN 'falling' ELSE 'stable' END AS trend FROM (
      SELECT book, round(avg(CASE WHEN 2 * ch_num <= n THEN pleasure_intensity END), 3) AS a, round(avg(CASE WHEN 2 * ch_num > n THEN pleasure_intensity END), 3) AS b, max(n) AS n
      FROM (SELECT book, ch_num, pleasure_intensity, count(*) OVER (PARTITION BY book) AS n FROM metrics) x GROUP BY book) y""",
)
def _(t):
    return s.halves(t.metrics)


@query(
    "plot_structure",
    """
    SELECT book, n, peak, CASE WHEN n < 10 THEN 'short' WHEN peak > n * 0.6e0 THEN 'late_climax' WHEN peak < n * 0.3e0 THEN 'early_climax' WHEN round(b, 9) > round(1.3e0 * a, 9) THEN 'rising' ELSE 'waves' END AS structure FROM (
      SELECT book, count(*) AS n, arg_max(ch_num, (pleasure_intensity, -ch_num)) - 1 AS peak, avg(CASE WHEN ch_num <= floor(n / 2) THEN pleasure_intensity END) AS a, avg(CASE WHEN ch_num > floor(n / 2) THEN pleasure_intensity END) AS b
      FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM metrics) x GROUP BY book) y""",
)
def _(t):
    return s.plot_structure(t.metrics)


EVENT_SCORES = (("error", 2), ("signup", 6), ("click view", 7), ("purchase", 9))


@query("emotion_scores", "SELECT user_id, ts, event_id, CAST(CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'signup' THEN 6 WHEN event_type IN ('click', 'view') THEN 7 WHEN event_type = 'purchase' THEN 9 ELSE 5 END AS BIGINT) AS score FROM events")
def _(t):
    return t.events.select("user_id", "ts", "event_id", s.emotion_score(F.col("event_type"), EVENT_SCORES).alias("score"))
