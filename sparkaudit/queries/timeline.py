"""Timeline, transcript and session queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.functions.symbols import symbols_of, words_of
from sparkaudit.operators import timeline as K
from sparkaudit.operators.ordering import spread
from sparkaudit.operators.transcripts import assemble_transcripts, gap_sessions
from sparkaudit.queries import table
from sparkaudit.sources.timelines import read_alignments

START = "2024-01-01 00:00:00"


def seconds(ts: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{START}', {ts})") / 1e6


SECONDS_SQL = f"((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / 1e6)"

KINDS = ["signup", "view", "click", "purchase", "error"]


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as keyframes of their user's timeline."""
    return table(spark, d, "events").select(
        "user_id", seconds().alias("t"), F.col("event_id").alias("seq"),
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("event_type")).cast("int").alias("viseme_index"),
        (F.col("value") / 100.0).alias("viseme_weight"), F.col("event_type").alias("emotion_a"),
    )


def hourly_probes(spark: SparkSession, d: str, hours: int = 24 * 31) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    every_six = F.explode(F.sequence(F.lit(0), F.lit(hours), F.lit(6)))
    return users.select("user_id", every_six.alias("h")).select("user_id", (F.col("h") * 3600.0).alias("now"))


def asof(spark, d):
    frames = event_frames(spark, d).select("user_id", "t", "seq")
    at = K.asof_bracket(hourly_probes(spark, d), frames, ["user_id"])
    return at.select("user_id", "now", F.col("prev.seq").alias("prev_seq"), F.col("next.seq").alias("next_seq"))


FRAMES_SQL = f"""
  f AS (SELECT user_id, {SECONDS_SQL} AS t, event_id AS seq, list_position({KINDS}, event_type)::INT AS viseme_index,
               value / 100.0::DOUBLE AS viseme_weight, event_type AS emotion_a FROM events),
  probe AS (SELECT user_id, h * 3600.0::DOUBLE AS now FROM (SELECT DISTINCT user_id FROM events), range(0, 745, 6) r(h)),
  bracket AS (SELECT p.user_id, p.now, a.seq AS prev_seq, b.seq AS next_seq,
                a.t AS ta, a.viseme_index AS ia, a.viseme_weight AS wa, a.emotion_a AS ea,
                b.t AS tb, b.viseme_index AS ib, b.viseme_weight AS wb, b.emotion_a AS eb
         FROM probe p ASOF LEFT JOIN f a ON a.user_id = p.user_id AND a.t <= p.now
                      ASOF LEFT JOIN f b ON b.user_id = p.user_id AND b.t > p.now)
"""


def interpolate(spark, d):
    return K.interpolate_at(
        hourly_probes(spark, d), event_frames(spark, d), ["user_id"], ["viseme_weight"],
        ["viseme_index", "emotion_a"], defaults={"viseme_index": 0, "emotion_a": "neutral"}, fade=50000.0,
    ).withColumn("viseme_weight", F.round("viseme_weight", 6))


INTERPOLATE_SQL = f"""WITH {FRAMES_SQL},
  g AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (now - ta) / (tb - ta))) AS x FROM bracket),
  h AS (SELECT *, CASE WHEN tb - ta <= 0 THEN 1.0::DOUBLE ELSE x * x * (3 - 2 * x) END AS s FROM g)
  SELECT user_id, now,
         round(CASE WHEN ta IS NULL THEN 0 WHEN tb IS NULL THEN wa * greatest(0.0::DOUBLE, 1 - (now - ta) / 50000.0::DOUBLE)
                    ELSE wa + (wb - wa) * s END, 6) AS viseme_weight,
         CASE WHEN ta IS NULL THEN 0 WHEN tb IS NULL OR s <= 0.5 THEN ia ELSE ib END AS viseme_index,
         CASE WHEN ta IS NULL THEN 'neutral' WHEN tb IS NULL OR s <= 0.5 THEN ea ELSE eb END AS emotion_a
  FROM h"""


def alignment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each event lasts value milliseconds; errors are silent."""
    kind = F.when(F.col("event_type") == "error", 0).otherwise(F.length("event_type"))
    return table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("pos"), seconds().alias("start"),
        (seconds() + F.col("value") / 1000.0).alias("end"), kind.alias("kind"),
    )


def run_starts(spark, d):
    frames = K.alignment_keyframes(alignment_rows(spark, d), ["user_id"], groups=F.col("kind"), symbol="kind")
    return frames.withColumn("t", F.round("t", 6))


RUN_STARTS_SQL = f"""
  WITH r AS (SELECT user_id, event_id AS pos, {SECONDS_SQL} AS s, {SECONDS_SQL} + value / 1000.0::DOUBLE AS e,
                    CASE WHEN event_type = 'error' THEN 0 ELSE length(event_type) END AS kind FROM events),
  g AS (SELECT *, CASE WHEN e - s < 0.01::DOUBLE THEN 0 ELSE kind END AS grp FROM r),
  b AS (SELECT *, coalesce(lag(grp) OVER (PARTITION BY user_id ORDER BY pos), -1) AS before FROM g),
  k AS (SELECT user_id, pos, unnest(CASE
          WHEN grp = 0 AND before <> 0 THEN [{{'t': s, 'i': 0, 'w': 0.0::DOUBLE}}]
          WHEN grp = 0 THEN []
          WHEN before <> grp THEN [{{'t': s, 'i': grp, 'w': 0.0::DOUBLE}}, {{'t': (s + e) / 2, 'i': grp, 'w': 1.0::DOUBLE}},
                                   {{'t': e, 'i': grp, 'w': 0.8::DOUBLE}}, {{'t': e + 0.035::DOUBLE, 'i': 0, 'w': 0.0::DOUBLE}}]
          ELSE [{{'t': (s + e) / 2, 'i': grp, 'w': 1.0::DOUBLE}}, {{'t': e, 'i': grp, 'w': 0.8::DOUBLE}},
                {{'t': e + 0.035::DOUBLE, 'i': 0, 'w': 0.0::DOUBLE}}] END) AS x,
        unnest(range(CASE WHEN grp = 0 AND before <> 0 THEN 1 WHEN grp = 0 THEN 0 WHEN before <> grp THEN 4 ELSE 3 END)) AS step
        FROM b)
  SELECT user_id, pos, step::INT AS step, round(x.t, 6) AS t, x.i::INT AS viseme_index, x.w AS viseme_weight FROM k
  UNION ALL
  SELECT user_id, max(pos) + 1, 0, round(arg_max(e, pos) + 0.3::DOUBLE, 6), 0, 0.0::DOUBLE FROM r GROUP BY user_id
"""


def alignment_payloads(spark, d):
    """Alignment documents of the conversation texts; ends are one shorter than the characters."""
    chars = F.split("text", "")
    docs = spread(table(spark, d, "conversations")).select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.to_json(
            F.struct(
                F.struct(
                    chars.alias("characters"),
                    F.transform(chars, lambda _, i: i * 0.25).alias("character_start_times_seconds"),
                    F.transform(F.slice(chars, F.lit(2), F.size(chars)), lambda _, i: i * 0.25 + 0.125).alias(
                        "character_end_times_seconds"
                    ),
                ).alias("alignment")
            )
        ).alias("payload"),
    )
    return K.alignment_keyframes(read_alignments(docs), ["id"]).filter("viseme_weight > 0.9").groupBy("id", "viseme_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("t_sum")
    )


ALIGNMENT_SQL = """
  WITH c AS (SELECT id, ch, i - 1 AS i FROM (
    SELECT conv_id || '/' || turn AS id, unnest(string_split(text, '')) AS ch,
           generate_subscripts(string_split(text, ''), 1) AS i, length(text) AS n FROM conversations) WHERE i < n),
  g AS (SELECT id, i, CASE lower(ch) WHEN 'a' THEN 1 WHEN 'e' THEN 2 WHEN 'i' THEN 3 WHEN 'y' THEN 3 WHEN 'o' THEN 4
          WHEN 'u' THEN 4 WHEN 'w' THEN 4 WHEN 'm' THEN 5 WHEN 'b' THEN 5 WHEN 'p' THEN 5 WHEN 'f' THEN 6 WHEN 'v' THEN 6
          WHEN 't' THEN 8 WHEN 'd' THEN 8 WHEN 'n' THEN 8 WHEN 'l' THEN 8 ELSE 0 END AS grp FROM c)
  SELECT id, grp::INT AS viseme_index, count(*) AS n, sum(i * 0.25::DOUBLE + 0.0625::DOUBLE) AS t_sum
  FROM g WHERE grp <> 0 GROUP BY id, grp
"""


def words_to_symbols(spark, d):
    words = spread(table(spark, d, "conversations")).select("conv_id", "turn", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    return words.withColumn("symbols", F.array_join(symbols_of(F.col("word")), ""))


SYMBOLS_SQL = """
  SELECT *, translate(regexp_replace(regexp_replace(lower(word), '([aeiou])[aeiou]*', '\\1', 'g'), '[^aeiyouwmbpfvtdnl]', '', 'g'),
                      'aeiyouwmbpfvtdnl', '1233444555668888') AS symbols
  FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-zA-Z'']+')) AS word,
               generate_subscripts(regexp_extract_all(text, '[a-zA-Z'']+'), 1)::INT - 1 AS pos FROM conversations)
"""


def symbol_schedule(spark, d):
    frames = K.symbol_schedule(spread(table(spark, d, "conversations")), ["conv_id", "turn"])
    return frames.withColumn("t", F.round("t", 6))


SCHEDULE_SQL = f"""
  WITH w AS ({SYMBOLS_SQL}),
  s AS (SELECT conv_id, turn, pos, code, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos, i) - 1 AS k
        FROM (SELECT conv_id, turn, pos, unnest(string_split(symbols, '')) AS code,
                     generate_subscripts(string_split(symbols, ''), 1) AS i FROM w WHERE symbols <> '')),
  m AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.08::DOUBLE, 0.85::DOUBLE),
                              (2, 0.43::DOUBLE, 0.85::DOUBLE), (3, 0.51::DOUBLE, 0.0::DOUBLE)) v(j, after, weight))
  SELECT conv_id, turn, (k * 4 + j)::INT AS seq, round(0.3::DOUBLE + k * 0.51::DOUBLE + pos * 0.15::DOUBLE + after, 6) AS t,
         code::INT AS viseme_index, weight AS viseme_weight FROM s CROSS JOIN m
  UNION ALL
  SELECT c.conv_id, c.turn, (coalesce(n, 0) * 4)::INT,
         round(0.6::DOUBLE + coalesce(n, 0) * 0.51::DOUBLE + len(regexp_extract_all(text, '[a-zA-Z'']+')) * 0.15::DOUBLE, 6), 0, 0.0::DOUBLE
  FROM conversations c LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM s GROUP BY ALL) USING (conv_id, turn)
"""


def moving_rate(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", seconds().alias("t"))
    rated = K.moving_rate(events, ["user_id"], "t", ["event_id"])
    return rated.select("event_id", F.round("rate", 9).alias("rate"))


MOVING_RATE_SQL = f"""
  SELECT event_id, round(CASE WHEN k >= 2 AND t > first_t THEN (k - 1) / (t - first_t) ELSE 0 END, 9) AS rate
  FROM (SELECT event_id, {SECONDS_SQL} AS t, count(*) OVER w AS k, first_value({SECONDS_SQL}) OVER w AS first_t FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


def merge_timeline(spark, d):
    """Each user's clicks are replaced from day 10 on by that user's purchases, then pruned at day 12."""
    frames = event_frames(spark, d).select("user_id", "t", "seq", "emotion_a")
    old, new = frames.filter("emotion_a = 'click'"), frames.filter("emotion_a = 'purchase' AND t >= 864000")
    merged = K.merge_timeline(old, new, F.lit(864000.0))
    return K.prune_timeline(merged, 1036800.0, ["user_id"])


MERGE_SQL = f"""
  WITH f AS (SELECT user_id, {SECONDS_SQL} AS t, event_id AS seq, event_type AS emotion_a FROM events),
  m AS (SELECT * FROM f WHERE (emotion_a = 'click' AND t < 864000) OR (emotion_a = 'purchase' AND t >= 864000)),
  l AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE t < 1036798) AS stale,
               max((t, seq)) FILTER (WHERE t < 1036798) AS cut FROM m GROUP BY 1)
  SELECT m.* FROM m JOIN l USING (user_id) WHERE n <= 4 OR stale <= 1 OR (t, seq) >= cut
"""


def transcripts(spark, d):
    return assemble_transcripts(table(spark, d, "conversations"))


def sessions(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    found = gap_sessions(
        events, ["user_id"], "ts", ["event_id"], 6 * 3600.0,
        [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")],
    )
    return found


SESSIONS_SQL = """
  SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(sum(value), 6) AS total
  FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session
        FROM (SELECT *, CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 21600000000 THEN 1 ELSE 0 END AS opens
              FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)))
  GROUP BY user_id, session
"""

QUERIES = {
    "q_asof": (asof, f"WITH {FRAMES_SQL} SELECT user_id, now, prev_seq, next_seq FROM bracket"),
    "q_interpolate": (interpolate, INTERPOLATE_SQL),
    "q_run_starts": (run_starts, RUN_STARTS_SQL),
    "q_alignments": (alignment_payloads, ALIGNMENT_SQL),
    "q_words_to_symbols": (words_to_symbols, SYMBOLS_SQL),
    "q_symbol_schedule": (symbol_schedule, SCHEDULE_SQL),
    "q_moving_rate": (moving_rate, MOVING_RATE_SQL),
    "q_merge_timeline": (merge_timeline, MERGE_SQL),
    "q_transcripts": (transcripts, """
      SELECT conv_id, 0::BIGINT AS part, count(*)::INT AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
      FROM conversations GROUP BY conv_id"""),
    "q_sessions": (sessions, SESSIONS_SQL),
}
