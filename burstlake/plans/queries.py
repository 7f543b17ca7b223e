"""A query per operator over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import halftone, tone, wrapping
from ..functions import layout as L
from ..functions import scalars as S
from ..operators import bursts as B
from ..operators import relate as R
from ..operators import segments as G
from ..operators import sinkplan as P
from ..operators import cull as C
from ..sources import convert as V
from .bindings import FILES_SQL, FRAMES_SQL, PORTRAITS_SQL, files, frames, portraits, table

#: Gaps that suit the events table, whose users pause for hours.
GAP, BREAK, NEAR = 14_400.0, 86_400.0, 3_600.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Folding to ASCII, written out for the SQL apart from the operator's own table.
_FOLDED = "text"
for _pair in "ж zh,ц ts,ч ch,ш sh,щ sch,ю yu,я ya,Ж Zh,Ц Ts,Ч Ch,Ш Sh,Щ Sch,Ю Yu,Я Ya,… ...,→ ->".split(","):
    _FOLDED = f"replace({_FOLDED}, '{_pair.split()[0]}', '{_pair.split()[1]}')"
_FOLDED = f"translate({_FOLDED}, 'абвгдеёзийклмнопрстуфхыэАБВГДЕЁЗИЙКЛМНОПРСТУФХЫЭ«»„“”‘’—–‑−×№•' || chr(160) || '─ъь', 'abvgdeeziyklmnoprstufhyeABVGDEEZIYKLMNOPRSTUFHYE\"\"\"\"\"''''----xN* -')"
_BURSTS = f"""{FRAMES_SQL}, lagged AS (SELECT *, t - lag(t) OVER w AS gap FROM frames WINDOW w AS (PARTITION BY shoot_id ORDER BY t, frame_id)),
 b AS (SELECT *, sum(CASE WHEN gap >= 0 AND gap <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY shoot_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) - 1 AS burst_id FROM lagged)"""
_SEGMENTS = f"""{FRAMES_SQL}, s AS (SELECT *, sum(CASE WHEN gap < {BREAK} THEN 0 ELSE 1 END) OVER (PARTITION BY shoot_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) - 1 AS segment_id
 FROM (SELECT *, t - lag(t) OVER (PARTITION BY shoot_id ORDER BY t, frame_id) AS gap FROM frames))"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return put


def _bursts(spark, sf_dir):
    return B.gap_bursts(frames(spark, sf_dir), GAP)


def _segments(spark, sf_dir):
    return G.break_segments(frames(spark, sf_dir), BREAK)


@query(f"WITH {_BURSTS} SELECT shoot_id, burst_id, frame_id, penalty, sharpness FROM b QUALIFY row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY penalty, sharpness DESC, frame_id) = 1")
def burst_best_shot(spark, sf_dir):
    """The best frame of each burst."""
    return B.burst_rank(_bursts(spark, sf_dir), ["shoot_id", "burst_id"], order="frame_id").where("burst_rank = 1").select("shoot_id", "burst_id", "frame_id", "penalty", "sharpness")


@query(f"WITH {_BURSTS} SELECT shoot_id, burst_id, count(*) AS n, min(t) AS t_first, max(t) AS t_last FROM b GROUP BY ALL")
def burst_sizes(spark, sf_dir):
    return _bursts(spark, sf_dir).groupBy("shoot_id", "burst_id").agg(F.count("*").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


@query(f"WITH {_BURSTS} SELECT shoot_id, burst_id, string_agg(frame_id, ',' ORDER BY penalty, sharpness DESC, frame_id) AS members FROM b GROUP BY ALL")
def burst_members(spark, sf_dir):
    """Members in order of rank."""
    df = B.burst_rank(_bursts(spark, sf_dir), ["shoot_id", "burst_id"], order="frame_id")
    got = F.transform(F.array_sort(F.collect_list(F.struct("burst_rank", "frame_id"))), lambda x: x["frame_id"].cast("string"))
    return df.groupBy("shoot_id", "burst_id").agg(F.array_join(got, ",").alias("members"))


@query(f"""WITH {FRAMES_SQL}, u AS (SELECT frame_id, shoot_id, CASE WHEN k % 5 = 0 THEN NULL ELSE t END AS t, k AS file_number, 'IMG_' || k AS name FROM frames),
 r AS (SELECT *, row_number() OVER w AS rk, last_value(t IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS prev, first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_t,
  2 * count(t) OVER (PARTITION BY shoot_id) >= count(*) OVER (PARTITION BY shoot_id) AND count(t) OVER (PARTITION BY shoot_id) > 0 AS timed
  FROM u WINDOW w AS (PARTITION BY shoot_id ORDER BY file_number, lower(name), lpad(CAST(frame_id AS VARCHAR), 12, '0')))
 SELECT shoot_id, frame_id, timed, row_number() OVER (PARTITION BY shoot_id ORDER BY CASE WHEN timed THEN coalesce(t, coalesce(prev, first_t) + 1e-3::DOUBLE * rk) END, file_number, CASE WHEN timed THEN lpad(CAST(frame_id AS VARCHAR), 12, '0') ELSE lower(name) END, lpad(CAST(frame_id AS VARCHAR), 12, '0')) - 1 AS capture_order FROM r""")
def capture_order(spark, sf_dir):
    """Every fifth time is unknown."""
    f = frames(spark, sf_dir)
    f = f.select("frame_id", "shoot_id", F.when(F.col("k") % 5 != 0, F.col("t")).alias("t"), F.col("k").alias("file_number"), F.concat(F.lit("IMG_"), F.col("k").cast("string")).alias("name"), F.lpad(F.col("frame_id").cast("string"), 12, "0").alias("path"))
    return B.capture_order(f).select("shoot_id", "frame_id", "timed", "capture_order")


@query(f"WITH {FRAMES_SQL} SELECT shoot_id, frame_id, round(t - first_value(t) OVER w, 3) AS t_rel, round(coalesce(t - lag(t) OVER w, 0), 3) AS pause FROM frames WINDOW w AS (PARTITION BY shoot_id ORDER BY t, frame_id)")
def relative_times(spark, sf_dir):
    """W3, W10, J8."""
    w = Window.partitionBy("shoot_id").orderBy("t", "frame_id")
    df = B.relative_time(frames(spark, sf_dir), order=("t", "frame_id"))
    return df.select("shoot_id", "frame_id", F.round("t_rel", 3).alias("t_rel"), F.round(B.pause("t", w), 3).alias("pause"))


@query(f"""WITH {_SEGMENTS} SELECT shoot_id, segment_id, frame_id, round(CASE WHEN n <= 1 THEN 0.5 ELSE (rk - 1 + 0.5 * (eq - 1)) / (n - 1) END, 9) AS pct FROM
 (SELECT *, CAST(count(*) OVER (PARTITION BY shoot_id, segment_id) AS DOUBLE) AS n, CAST(rank() OVER (PARTITION BY shoot_id, segment_id ORDER BY k) AS DOUBLE) AS rk, CAST(count(*) OVER (PARTITION BY shoot_id, segment_id, k) AS DOUBLE) AS eq FROM s)""")
def segment_midrank(spark, sf_dir):
    """W5."""
    return B.mid_rank(_segments(spark, sf_dir), "k", ["shoot_id", "segment_id"]).select("shoot_id", "segment_id", "frame_id", F.round("pct", 9).alias("pct"))


@query(f"""WITH {_SEGMENTS}, m AS (SELECT *, median(sharpness) OVER (PARTITION BY shoot_id, segment_id) AS med, count(*) OVER (PARTITION BY shoot_id, segment_id) AS n FROM s),
 d AS (SELECT *, 1.4826::DOUBLE * median(abs(sharpness - med)) OVER (PARTITION BY shoot_id, segment_id) AS mad FROM m)
 SELECT shoot_id, segment_id, frame_id, round(med, 6) AS med, round(mad, 6) AS mad, sharpness < 2.0 OR (n >= 6 AND mad > 0 AND sharpness < med - 2.5::DOUBLE * mad) AS soft FROM d""")
def mad_soft_flag(spark, sf_dir):
    """A8, P3."""
    df = B.soft_flags(_segments(spark, sf_dir), "sharpness", ["shoot_id", "segment_id"], floor=2.0)
    return df.select("shoot_id", "segment_id", "frame_id", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), "soft")


@query(f"""WITH {_SEGMENTS} SELECT shoot_id, segment_id, frame_id, row_number() OVER (PARTITION BY shoot_id, segment_id ORDER BY sharpness DESC NULLS LAST, frame_id) AS place, count(sharpness) OVER (PARTITION BY shoot_id, segment_id) AS "of" FROM s""")
def sharpness_place(spark, sf_dir):
    """W7."""
    return B.place(_segments(spark, sf_dir), "sharpness", ["shoot_id", "segment_id"], "frame_id").select("shoot_id", "segment_id", "frame_id", "place", "of")


@query(f"""WITH {FRAMES_SQL} SELECT shoot_id, frame_id, round(CASE WHEN event_type = 'error' THEN coalesce(min(CASE WHEN event_type <> 'error' THEN sharpness END) OVER (PARTITION BY shoot_id), 0) - 1 ELSE sharpness END, 6) AS score FROM frames""")
def unreadable_floor(spark, sf_dir):
    """A7."""
    f = frames(spark, sf_dir).withColumn("_s", F.when(F.col("event_type") != "error", F.col("sharpness")))
    floor = B.sharpness_floor("_s", Window.partitionBy("shoot_id"))
    return f.select("shoot_id", "frame_id", F.round(F.coalesce("_s", floor), 6).alias("score"))


@query(f"""WITH {_BURSTS} SELECT shoot_id, frame_id, burst_id, CASE WHEN k % 3 = 0 THEN k END IS NULL AND max(CASE WHEN k % 3 = 0 THEN k END) OVER p IS NULL AS no_face,
 coalesce(CASE WHEN k % 3 = 0 THEN k END, first_value(CASE WHEN k % 3 = 0 THEN k END) OVER (PARTITION BY shoot_id, burst_id ORDER BY CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END, sharpness DESC, frame_id)) AS face_box FROM b WINDOW p AS (PARTITION BY shoot_id, burst_id)""")
def burst_face_donor(spark, sf_dir):
    """A frame whose k is a multiple of three has a face, k itself."""
    df = _bursts(spark, sf_dir).withColumn("face_box", F.when(F.col("k") % 3 == 0, F.col("k"))).withColumn("capture_order", F.col("frame_id"))
    df = df.withColumn("flags", F.array_compact(F.array(F.when(F.col("face_box").isNull(), "no_face"))))
    return B.share_in_burst(df, ["shoot_id", "burst_id"]).select("shoot_id", "frame_id", "burst_id", F.array_contains("flags", "no_face").alias("no_face"), "face_box")


@query(f"WITH {_BURSTS} SELECT shoot_id, burst_id, count(DISTINCT event_type) > 1 AS mixed FROM b GROUP BY ALL")
def burst_mixed_basis(spark, sf_dir):
    """A9."""
    return _bursts(spark, sf_dir).groupBy("shoot_id", "burst_id").agg((F.size(F.collect_set("event_type")) > 1).alias("mixed"))


@query(f"""WITH {_SEGMENTS} SELECT shoot_id, segment_id, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM s GROUP BY ALL""")
def segment_ranges(spark, sf_dir):
    """K1's sure cuts."""
    return _segments(spark, sf_dir).groupBy("shoot_id", "segment_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"))


_K1 = f"""WITH RECURSIVE {FRAMES_SQL}, o AS (SELECT shoot_id, t, row_number() OVER (PARTITION BY shoot_id ORDER BY t, frame_id) - 1 AS i FROM frames),
 g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY shoot_id ORDER BY i), 0) AS gap FROM o),
 base AS (SELECT *, sum(CASE WHEN gap >= {BREAK} THEN 1 ELSE 0 END) OVER (PARTITION BY shoot_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM g),
 seg(shoot_id, a, z) AS (SELECT shoot_id, min(i), max(i) FROM base GROUP BY shoot_id, c UNION ALL
  SELECT s.shoot_id, CASE side WHEN 0 THEN s.a ELSE s.best END, CASE side WHEN 0 THEN s.best - 1 ELSE s.z END FROM (SELECT seg.shoot_id, seg.a, seg.z,
   (SELECT x.i FROM g x WHERE x.shoot_id = seg.shoot_id AND x.i BETWEEN seg.a + 3 AND seg.z - 2 AND x.gap >= {NEAR} ORDER BY x.gap DESC, x.i DESC LIMIT 1) AS best FROM seg
   JOIN g ga ON ga.shoot_id = seg.shoot_id AND ga.i = seg.a JOIN g gz ON gz.shoot_id = seg.shoot_id AND gz.i = seg.z WHERE gz.t - ga.t > {GAP * 6}) s, (VALUES (0), (1)) v(side) WHERE s.best IS NOT NULL)"""


@query(f"{_K1}, st AS (SELECT DISTINCT shoot_id, a FROM seg) SELECT o.shoot_id, o.i AS capture_order, sum(CASE WHEN st.a IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY o.shoot_id ORDER BY o.i ROWS UNBOUNDED PRECEDING) - 1 AS segment_id FROM o LEFT JOIN st ON st.shoot_id = o.shoot_id AND st.a = o.i")
def segment_split(spark, sf_dir):
    """K1, recursive longest-pause segmentation, every frame a legal cut."""
    f = frames(spark, sf_dir)
    w = Window.partitionBy("shoot_id").orderBy("t", "frame_id")
    f = f.withColumn("capture_order", F.row_number().over(w) - 1).withColumn("timed", F.lit(True)).withColumn("burst_id", F.col("capture_order"))
    return G.split_segments(f, G.SegmentRules(BREAK, GAP * 6, NEAR, 3))


_CAP = """cap AS (SELECT o_custkey AS shoot_id, o_orderpriority AS segment_id, count(*) AS capacity FROM orders GROUP BY ALL), n AS (SELECT *, 3 + shoot_id % 7 AS n FROM cap),
 l AS (SELECT *, count(*) OVER (PARTITION BY shoot_id) AS live FROM n), x AS (SELECT *, unnest(CASE WHEN capacity > 1 THEN range(1, capacity) ELSE [] END) AS k FROM l WHERE n > live),
 r AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY pow(CAST(capacity AS DOUBLE), 0.5::DOUBLE) / (k + 0.5::DOUBLE) DESC, segment_id, k) AS p FROM x), e AS (SELECT shoot_id, segment_id, count(*) AS extra FROM r WHERE p <= n - live GROUP BY ALL),
 few AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY segment_id) - 1 AS at_, CAST(live AS DOUBLE) / n AS step FROM l WHERE n < live), ch AS (SELECT *, len([j for j in range(1, n + 1) if CAST(floor(j * step) AS BIGINT) <= at_]) AS chunk FROM few),
 pk AS (SELECT shoot_id, segment_id, row_number() OVER (PARTITION BY shoot_id, chunk ORDER BY capacity DESC, segment_id) = 1 AS first_ FROM ch)"""


@query(f"WITH {_CAP} SELECT l.shoot_id, l.segment_id, l.capacity, CASE WHEN l.n < l.live THEN CASE WHEN pk.first_ THEN 1 ELSE 0 END ELSE 1 + coalesce(e.extra, 0) END AS quota FROM l LEFT JOIN e USING (shoot_id, segment_id) LEFT JOIN pk USING (shoot_id, segment_id)")
def quota_sainte_lague(spark, sf_dir):
    """K3, K4: picks over the priorities of a customer's orders."""
    cap = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("shoot_id"), F.col("o_orderpriority").alias("segment_id")).agg(F.count("*").alias("capacity"))
    return G.apportion(cap.withColumn("n", 3 + F.col("shoot_id") % 7)).select("shoot_id", "segment_id", "capacity", "quota")


def _reps(spark, sf_dir):
    df = B.burst_rank(_bursts(spark, sf_dir), ["shoot_id", "burst_id"], order="frame_id").where("burst_rank = 1")
    df = G.break_segments(df, BREAK)
    df = B.mid_rank(df, "sharpness", ["shoot_id", "segment_id"])
    df = B.relative_time(df, order=("t", "frame_id"))
    return df.withColumn("capture_order", F.col("frame_id"))


def _picks_sql(n):
    """K2 over ``_reps``, whose frames are alike by time within a segment: each segment's picks are a fold over its queue.

    ``n``: SQL for the number wanted. ``quota`` is the divisor method twice, over frames that are apart and over the rest.
    """

    def shares(name, source, cap, want):
        return f"""{name}_l AS (SELECT shoot_id, segment_id, {cap} AS cap, {want} AS n, count(*) FILTER ({cap} > 0) OVER (PARTITION BY shoot_id) AS live FROM {source}),
 {name}_x AS (SELECT *, unnest(range(1, cap)) AS k FROM {name}_l WHERE n >= live AND cap > 1),
 {name}_e AS (SELECT shoot_id, segment_id, count(*) AS extra FROM (SELECT * FROM {name}_x QUALIFY row_number() OVER (PARTITION BY shoot_id ORDER BY pow(cap::DOUBLE, 0.5::DOUBLE) / (k + 0.5::DOUBLE) DESC, segment_id, k) <= n - live) GROUP BY ALL),
 {name}_c AS (SELECT *, len([j for j in range(1, n + 1) if floor(j * (live::DOUBLE / n))::BIGINT <= at_]) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY segment_id) - 1 AS at_ FROM {name}_l WHERE n < live AND n > 0 AND cap > 0)),
 {name}_f AS (SELECT shoot_id, segment_id FROM {name}_c QUALIFY row_number() OVER (PARTITION BY shoot_id, chunk ORDER BY cap DESC, segment_id) = 1),
 {name} AS (SELECT l.shoot_id, l.segment_id, CASE WHEN l.cap <= 0 OR l.n <= 0 THEN 0 WHEN l.n < l.live THEN CASE WHEN f.shoot_id IS NULL THEN 0 ELSE 1 END ELSE 1 + coalesce(e.extra, 0) END AS q
  FROM {name}_l l LEFT JOIN {name}_e e USING (shoot_id, segment_id) LEFT JOIN {name}_f f ON f.shoot_id = l.shoot_id AND f.segment_id = l.segment_id)"""

    near = NEAR * 8
    return f"""{_BURSTS}, rep AS (SELECT shoot_id, frame_id, t, penalty, sharpness FROM b QUALIFY row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY penalty, sharpness DESC, frame_id) = 1),
 rs AS (SELECT *, sum(CASE WHEN gap < {BREAK} THEN 0 ELSE 1 END) OVER (PARTITION BY shoot_id ORDER BY t, frame_id ROWS UNBOUNDED PRECEDING) - 1 AS segment_id FROM (SELECT *, t - lag(t) OVER (PARTITION BY shoot_id ORDER BY t, frame_id) AS gap FROM rep)),
 rp AS (SELECT *, t - min(t) OVER (PARTITION BY shoot_id) AS t_rel, CASE WHEN c <= 1 THEN 0.5::DOUBLE ELSE (rk - 1 + 0.5::DOUBLE * (eq - 1)) / (c - 1) END AS pct FROM (SELECT *, count(*) OVER (PARTITION BY shoot_id, segment_id)::DOUBLE AS c,
  rank() OVER (PARTITION BY shoot_id, segment_id ORDER BY sharpness)::DOUBLE AS rk, count(*) OVER (PARTITION BY shoot_id, segment_id, sharpness)::DOUBLE AS eq FROM rs)),
 pool AS (SELECT shoot_id, segment_id, count(*) AS m, list(t_rel ORDER BY penalty, pct DESC, frame_id) AS ts, list(penalty ORDER BY penalty, pct DESC, frame_id) AS ps, list(frame_id ORDER BY penalty, pct DESC, frame_id) AS ids FROM rp GROUP BY ALL),
 apart AS (SELECT *, len(list_reduce([[i] for i in range(2, m + 1)], lambda acc, x: CASE WHEN len([j for j in acc if abs(ts[j] - ts[x[1]]) <= {near}]) > 0 THEN acc ELSE acc || x END, [1::BIGINT])) AS d FROM pool),
 want AS (SELECT *, least({n}, sum(m) OVER (PARTITION BY shoot_id))::BIGINT AS n, sum(d) OVER (PARTITION BY shoot_id)::BIGINT AS ds FROM apart),
 {shares("q1", "want", "d", "least(n, ds)")},
 left_ AS (SELECT w.shoot_id, w.segment_id, w.n, w.m - q1.q AS spare, (sum(q1.q) OVER (PARTITION BY w.shoot_id))::BIGINT AS have FROM want w JOIN q1 USING (shoot_id, segment_id)),
 {shares("q2", "left_", "spare", "n - have")},
 quota AS (SELECT w.*, q1.q + q2.q AS quota FROM want w JOIN q1 USING (shoot_id, segment_id) JOIN q2 USING (shoot_id, segment_id)),
 taken AS (SELECT *, list_reduce([[k] for k in range(2, quota + 1)], lambda acc, x: acc || [list_min([{{'p': ps[i], 'd': len([j for j in acc if abs(ts[j] - ts[i]) <= {near}]) > 0, 'i': i}} for i in range(1, m + 1) if NOT list_contains(acc, i)]).i], [1::BIGINT]) AS got FROM quota WHERE quota > 0),
 each_ AS (SELECT shoot_id, segment_id, generate_subscripts(got, 1) - 1 AS round, unnest([ids[i] for i in got]) AS capture_order, unnest([ps[i] for i in got]) AS penalty FROM taken),
 picks AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY penalty, round, capture_order) - 1 AS place FROM each_)"""


@query(f"WITH {_picks_sql(30)} SELECT shoot_id, capture_order, segment_id, penalty, round, place FROM picks")
def suggested_picks(spark, sf_dir):
    """K2, K8, T-3, P5 by time: up to 30 picks a shoot."""
    return G.suggest(_reps(spark, sf_dir), 30, G.PickRules(near_s=NEAR * 8))


@query(f"""WITH {_picks_sql(1_000_000)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY penalty, sharpness DESC, frame_id) AS burst_rank FROM b),
 lead_ AS (SELECT r.shoot_id, r.burst_id, min(p.place) AS lead_ FROM ranked r JOIN picks p ON p.shoot_id = r.shoot_id AND p.capture_order = r.frame_id GROUP BY ALL)
 SELECT r.shoot_id, r.frame_id, row_number() OVER (PARTITION BY r.shoot_id ORDER BY CASE WHEN p.place IS NOT NULL THEN 0 WHEN l.lead_ IS NOT NULL THEN 1 ELSE 2 END, coalesce(p.place, l.lead_, r.frame_id), r.burst_rank, r.frame_id) - 1 AS full_place
 FROM ranked r LEFT JOIN picks p ON p.shoot_id = r.shoot_id AND p.capture_order = r.frame_id LEFT JOIN lead_ l ON l.shoot_id = r.shoot_id AND l.burst_id = r.burst_id""")
def every_frame_in_order(spark, sf_dir):
    """K6, U4."""
    df = B.burst_rank(_bursts(spark, sf_dir), ["shoot_id", "burst_id"], order="frame_id").withColumn("capture_order", F.col("frame_id"))
    picks = G.suggest(_reps(spark, sf_dir), None, G.PickRules(near_s=NEAR * 8))
    return G.full_order(df, picks).select("shoot_id", "frame_id", "full_place")


_K8 = f"""WITH RECURSIVE {PORTRAITS_SQL}, r AS (SELECT *, row_number() OVER w AS rk, last_value(t IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS prev, first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_t FROM portraits WINDOW w AS (PARTITION BY shoot_id ORDER BY frame_id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY coalesce(t, coalesce(prev, first_t) + 1e-3::DOUBLE * rk), frame_id) - 1 AS i FROM r),
 cand AS (SELECT *, x > 2 AND y > 2 AND x + s < 638 AND y + s < 430 AS inner_, s * s * (1 - 0.6::DOUBLE * least(sqrt(pow((x + s / 2.0::DOUBLE) / 640 - 0.5::DOUBLE, 2) + pow((y + s / 2.0::DOUBLE) / 432 - 0.5::DOUBLE, 2)), 1)) AS v FROM faces WHERE s >= 32),
 subj AS (SELECT * FROM (SELECT *, bool_or(inner_) OVER (PARTITION BY frame_id) AS any_ FROM cand) WHERE inner_ OR NOT any_ QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, k) = 1),
 a AS (SELECT o.*, s.s, s.clip_hi, s.mean, CASE WHEN NOT bad AND s.s IS NOT NULL THEN ln(greatest(s.ten_n, 1e-9::DOUBLE)) - 0.596::DOUBLE * ln(s.s::DOUBLE) END AS face_score FROM o LEFT JOIN subj s USING (frame_id)),
 sl AS (SELECT shoot_id, list(face_score ORDER BY face_score) FILTER (face_score IS NOT NULL) AS fs FROM a GROUP BY 1),
 rest AS (SELECT a.shoot_id, a.frame_id, a.frame_sharp, fs, (row_number() OVER (PARTITION BY a.shoot_id ORDER BY frame_sharp, i) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY a.shoot_id) * (len(fs) - 1) AS at_ FROM a JOIN sl USING (shoot_id) WHERE NOT bad AND face_score IS NULL),
 rv AS (SELECT shoot_id, frame_id, CASE WHEN len(fs) >= 5 THEN fs[floor(at_)::BIGINT + 1] + (fs[least(floor(at_)::BIGINT + 2, len(fs))] - fs[floor(at_)::BIGINT + 1]) * (at_ - floor(at_)) ELSE frame_sharp END AS v FROM rest),
 sc AS (SELECT a.*, coalesce(face_score, rv.v) AS known, CASE WHEN face_score IS NOT NULL THEN 'face' WHEN rv.v IS NOT NULL THEN 'frame' END AS basis FROM a LEFT JOIN rv USING (shoot_id, frame_id)),
 sh AS (SELECT *, coalesce(known, min(known) OVER (PARTITION BY shoot_id) - 1) AS sharpness, t - lag(t) OVER w AS gap, lag(bits) OVER w AS bits0, lag(size) OVER w AS size0, lag(bad) OVER w AS bad0 FROM sc WINDOW w AS (PARTITION BY shoot_id ORDER BY i)),
 jn AS (SELECT *, list_sum([CASE WHEN bits[k] <> bits0[k] THEN 1 ELSE 0 END for k in range(1, 65)]) AS ham, list_sum([least(size[k] / list_sum(size), size0[k] / list_sum(size0)) for k in range(1, 65)]) AS inter FROM sh),
 bu AS (SELECT *, sum(CASE WHEN NOT bad AND NOT bad0 AND gap >= 0 AND gap <= 8 AND (ham <= 12 OR inter >= 0.88 OR (gap <= 2.5 AND ham <= 22)) THEN 0 ELSE 1 END) OVER (PARTITION BY shoot_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS burst_id FROM jn),
 g AS (SELECT *, coalesce(gap, 0) AS pause, coalesce(burst_id <> lag(burst_id) OVER (PARTITION BY shoot_id ORDER BY i), true) AS legal FROM bu),
 pc AS (SELECT *, sum(CASE WHEN legal AND pause >= 180 THEN 1 ELSE 0 END) OVER (PARTITION BY shoot_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM g),
 seg(shoot_id, a, z) AS (SELECT shoot_id, min(i), max(i) FROM pc GROUP BY shoot_id, c UNION ALL
  SELECT s.shoot_id, CASE side WHEN 0 THEN s.a ELSE s.best END, CASE side WHEN 0 THEN s.best - 1 ELSE s.z END FROM (SELECT seg.shoot_id, seg.a, seg.z,
   (SELECT x.i FROM g x WHERE x.shoot_id = seg.shoot_id AND x.i BETWEEN seg.a + 3 AND seg.z - 2 AND x.legal AND x.pause >= 30 ORDER BY x.pause DESC, x.i DESC LIMIT 1) AS best FROM seg
   JOIN g ga ON ga.shoot_id = seg.shoot_id AND ga.i = seg.a JOIN g gz ON gz.shoot_id = seg.shoot_id AND gz.i = seg.z WHERE gz.t - ga.t > 300) s, (VALUES (0), (1)) v(side) WHERE s.best IS NOT NULL),
 st AS (SELECT DISTINCT shoot_id, a FROM seg), sg AS (SELECT g.*, sum(CASE WHEN st.a IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g.shoot_id ORDER BY g.i ROWS UNBOUNDED PRECEDING) - 1 AS segment_id FROM g LEFT JOIN st ON st.shoot_id = g.shoot_id AND st.a = g.i),
 m AS (SELECT *, median(sharpness) OVER p AS med, count(*) OVER p AS n, rank() OVER (PARTITION BY shoot_id, segment_id, bad ORDER BY sharpness) AS rk2, count(*) OVER (PARTITION BY shoot_id, segment_id, bad, sharpness) AS eq FROM sg WINDOW p AS (PARTITION BY shoot_id, segment_id, bad)),
 d AS (SELECT *, 1.4826::DOUBLE * median(abs(sharpness - med)) OVER (PARTITION BY shoot_id, segment_id, bad) AS mad, max(CASE WHEN NOT bad AND s IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY shoot_id, burst_id) = 1 AS lent FROM m),
 fl AS (SELECT *, CASE WHEN bad THEN ['unreadable'] ELSE (CASE WHEN lapvar < 120 OR (n >= 6 AND mad > 0 AND sharpness < med - 2.5::DOUBLE * mad) THEN ['soft'] ELSE [] END) || (CASE WHEN n_faces = 0 AND NOT lent THEN ['no_face'] ELSE [] END)
  || (CASE WHEN clip_hi > 0.02 THEN ['blown_face'] ELSE [] END) || (CASE WHEN mean < 45 THEN ['dark_face'] ELSE [] END) END AS flags FROM d),
 pe AS (SELECT *, list_sum([CASE f WHEN 'unreadable' THEN 100 WHEN 'soft' THEN 4 WHEN 'no_face' THEN 1 ELSE 2 END for f in flags]) AS pen, max(CASE WHEN basis = 'face' THEN 1 ELSE 0 END) OVER q + max(CASE WHEN basis = 'frame' THEN 1 ELSE 0 END) OVER q = 2 AS mixed FROM fl WINDOW q AS (PARTITION BY shoot_id, burst_id))
 SELECT shoot_id, frame_id, i AS capture_order, burst_id, segment_id, round(sharpness, 6) AS sharpness, basis, round(CASE WHEN bad THEN NULL WHEN n <= 1 THEN 0.5::DOUBLE ELSE (rk2 - 1 + 0.5::DOUBLE * (eq - 1)) / (n - 1) END, 6) AS pct, array_to_string(flags, ',') AS flags, coalesce(pen, 0)::INT AS penalty,
 row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY coalesce(pen, 0), CASE WHEN mixed AND NOT bad THEN frame_sharp ELSE sharpness END DESC, i) AS burst_rank FROM pe"""


@query(_K8)
def cull_result(spark, sf_dir):
    """K8 whole: W1-W3, F13, W8, A7, P4, W2, K1, W5, A8, P3, W9, A9, X19, W6."""
    df = C.build_result(portraits(spark, sf_dir))
    return df.select("shoot_id", "frame_id", "capture_order", "burst_id", "segment_id", F.round("sharpness", 6).alias("sharpness"), "basis", F.round("pct", 6).alias("pct"), F.array_join("flags", ",").alias("flags"), "penalty", "burst_rank")


@query("""SELECT l_returnflag, count(*) AS seen, count_if(l_linestatus = 'O') AS ok, count_if(l_linestatus <> 'O') AS failed, count_if(l_discount > 0.05) AS full_n, count_if(l_discount <= 0.05 AND l_quantity < 10) AS small_n, round(sum(l_extendedprice), 2) AS bytes,
 greatest(0, count_if(l_linestatus = 'O') - count_if(l_discount > 0.05)) AS reduced FROM lineitem GROUP BY 1""")
def run_totals(spark, sf_dir):
    """A1-A5: one pass of conditional counts; small only where not full."""
    full, ok = F.col("l_discount") > 0.05, F.col("l_linestatus") == "O"
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("seen"), *R.count_where(ok=ok, failed=~ok, full_n=full, small_n=~full & (F.col("l_quantity") < 10)), F.round(F.sum("l_extendedprice"), 2).alias("bytes"))
    return df.withColumn("reduced", F.greatest(F.lit(0), F.col("ok") - F.col("full_n")))


@query(f"""WITH {FILES_SQL}, c AS (SELECT *, CASE WHEN lower(ext) IN ('jpg', 'jpeg') THEN 'j' ELSE 'r' END AS kd, lower(stem) AS ls FROM files), n AS (SELECT *, row_number() OVER (PARTITION BY dir, ls, kd ORDER BY pos) AS rn FROM c),
 r AS (SELECT dir, ls, path AS raw FROM n WHERE kd = 'r' AND rn = 1), j AS (SELECT dir, ls FROM n WHERE kd = 'j' AND rn = 1)
 SELECT n.pos, n.path, CASE WHEN n.kd = 'j' AND n.rn = 1 THEN r.raw END AS pair_path FROM n LEFT JOIN r USING (dir, ls) LEFT JOIN j USING (dir, ls) WHERE NOT (n.kd = 'r' AND n.rn = 1 AND j.dir IS NOT NULL)""")
def raw_jpeg_pairs(spark, sf_dir):
    """J1, J3, S3."""
    return R.raw_jpeg_pairs(files(spark, sf_dir)).select("pos", "path", "pair_path")


@query(f"WITH {FILES_SQL} SELECT pos, path FROM files f WHERE lower(ext) NOT IN ('cr2') OR NOT EXISTS (SELECT 1 FROM files g WHERE g.dir = f.dir AND lower(g.stem) = lower(f.stem) AND lower(g.ext) IN ('jpg', 'jpeg'))")
def unpaired_anti(spark, sf_dir):
    """J2."""
    return R.drop_raw_twins(files(spark, sf_dir)).select("pos", "path")


@query("SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS dst, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1")
def latest_processed(spark, sf_dir):
    """The last writer wins."""
    df = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return R.latest_per_key(df, ["l_partkey"], "dst", "seq")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def remaining_work(spark, sf_dir):
    """J10, J11, U3."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def only_ticked(spark, sf_dir):
    """J5, P8."""
    return R.ticked(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query(f"WITH {_SEGMENTS}, r AS (SELECT shoot_id, segment_id, min(t) AS a, max(t) AS z FROM s GROUP BY ALL) SELECT f.shoot_id, f.frame_id, r.segment_id FROM frames f JOIN r ON r.shoot_id = f.shoot_id AND f.t BETWEEN r.a AND r.z")
def segment_of_frame(spark, sf_dir):
    """Range containment."""
    ranges = _segments(spark, sf_dir).groupBy("shoot_id", "segment_id").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    return R.in_range(frames(spark, sf_dir).select("shoot_id", "frame_id", "t"), ranges, ["shoot_id"], "t", "a", "z").select("shoot_id", "frame_id", "segment_id")


@query("""SELECT a.vec_id, b.vec_id AS other, list_sum([CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END for i in range(1, 65)])::INT AS bits FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
 WHERE list_sum([CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END for i in range(1, 65)]) <= 24""")
def hamming_pairs(spark, sf_dir):
    """F3, F4; of J9 and P5 the Hamming test alone, within a label."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", S.sign_hash(F.col("embedding")).alias("hash"))
    return R.near_pairs(df, "vec_id", ["label"], "hash", 24).select("vec_id", "other", "bits")


@query("""WITH v AS (SELECT vec_id // 500 AS shoot_id, vec_id, CAST(vec_id * 37 % 9001 AS DOUBLE) AS t, label, embedding FROM embeddings),
 p AS (SELECT a.shoot_id, a.vec_id, b.vec_id AS other, abs(a.t - b.t) AS apart, a.label = b.label AS same, list_sum([CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END for i in range(1, 65)]) AS bits,
 round(list_sum([CAST(a.embedding[i] AS DOUBLE) * b.embedding[i] for i in range(1, 65)]), 6) AS corr FROM v a JOIN v b ON a.shoot_id = b.shoot_id AND a.vec_id < b.vec_id)
 SELECT shoot_id, vec_id, other FROM p WHERE bits <= 12 OR (bits <= 16 AND apart <= 60) OR (same AND apart <= 10) OR corr >= 0.6""")
def near_duplicate_pairs(spark, sf_dir):
    """The whole predicate, across segments; five hundred vectors make a shoot."""
    e = table(spark, sf_dir, "embeddings").withColumn("shoot_id", F.expr("vec_id div 500")).withColumn("t", (F.col("vec_id") * 37 % 9001).cast("double"))
    return R.near_duplicates(e.withColumn("hash", S.sign_hash(F.col("embedding"))), "vec_id", ["shoot_id"], "hash", "t", "label", "embedding")


@query("""SELECT a.vec_id, arg_max(b.vec_id, struct_pack(d := round(list_sum([CAST(a.embedding[i] AS DOUBLE) * b.embedding[i] for i in range(1, 65)]), 6), o := -b.vec_id)) AS best, max(round(list_sum([CAST(a.embedding[i] AS DOUBLE) * b.embedding[i] for i in range(1, 65)]), 6)) AS corr
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1""")
def signature_topk(spark, sf_dir):
    """Each vector's closest within its label."""
    return R.closest(table(spark, sf_dir, "embeddings"), "vec_id", ["label"], "embedding")


@query("SELECT a.vec_id, b.vec_id AS other, round(list_sum([least(abs(CAST(a.embedding[i] AS DOUBLE)), abs(CAST(b.embedding[i] AS DOUBLE))) for i in range(1, 65)]), 6) AS inter FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def hist_intersection(spark, sf_dir):
    """F7, on sizes of components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", F.abs).alias("h"))
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("h").alias("h2"))
    return e.join(o, "vec_id").select("vec_id", "other", F.round(S.histogram_intersection(F.col("h"), F.col("h2")), 6).alias("inter"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def distinct_keep_first(spark, sf_dir):
    """U1."""
    return R.distinct_keep_first(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
 SELECT k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k FROM b WHERE k NOT IN (SELECT k FROM a)""")
def symmetric_diff(spark, sf_dir):
    """Customers with an urgent order or a finished one, but not both."""
    o = table(spark, sf_dir, "orders")
    return R.symmetric_difference(o.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 ORDER BY o_orderkey DESC LIMIT 200")
def upsert_tail(spark, sf_dir):
    """U5, T-9, of T-8 the newest: the 200 keys written last."""
    return R.upsert_tail(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", 200)


@query("SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS place FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 100")
def three_state_sort(spark, sf_dir):
    """T-5: descending turns ties as well; the first screen of 100 rows. The whole column is three_state_sort_whole."""
    top = R.three_state_sort(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_size", "p_partkey", "desc").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("p_size").desc(), F.col("p_partkey").desc())))


@query("""SELECT 'off' AS state, p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_partkey) AS place FROM part
 UNION ALL SELECT 'asc', p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_size, p_partkey) FROM part
 UNION ALL SELECT 'desc', p_partkey, p_brand, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) FROM part""")
def three_state_sort_whole(spark, sf_dir):
    """T-5: every row's place in each state, as the operator orders them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    off, asc, desc = (R.placed(R.three_state_sort(p, "p_size", "p_partkey", s)).withColumn("state", F.lit(s)) for s in ("off", "asc", "desc"))
    return off.unionByName(asc).unionByName(desc).select("state", "p_partkey", "p_brand", "p_size", "place")


@query(f"""WITH {FILES_SQL}, j AS (SELECT f.pos, f.path, (SELECT min(g.path) FROM files g WHERE g.dir = f.dir AND lower(g.stem) = lower(f.stem) AND g.ext = 'CR2') AS pair FROM files f WHERE f.ext <> 'CR2')
 SELECT pos, 0 AS nth, path AS src FROM j UNION ALL SELECT pos, 1, pair FROM j WHERE pair IS NOT NULL""")
def export_list(spark, sf_dir):
    """Each pick and its RAW."""
    f = files(spark, sf_dir)
    raw = f.where("ext = 'CR2'").groupBy("dir", F.lower("stem").alias("_s")).agg(F.min("path").alias("pair_path"))
    picks = f.where("ext <> 'CR2'").withColumn("_s", F.lower("stem")).join(raw, ["dir", "_s"], "left")
    return R.with_pairs(picks).select("pos", "nth", "src")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'user' END, d.source) AS source FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def user_override(spark, sf_dir):
    """J16, J17."""
    user = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).select("doc_id", F.when(F.col("q") == 0, "user").alias("chosen"))
    return R.override(table(spark, sf_dir, "documents").select("doc_id", "source"), user, ["doc_id"], "source", "chosen").select("doc_id", "source")


@query("SELECT page_id, CAST(coalesce(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), ''), '-1') AS BIGINT) AS file_number FROM pages")
def file_number(spark, sf_dir):
    """X2."""
    return table(spark, sf_dir, "pages").select("page_id", S.file_number(F.col("url")).cast("long").alias("file_number"))


@query("SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), '_+$', '') AS slug FROM pages")
def slug(spark, sf_dir):
    """X8."""
    return table(spark, sf_dir, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("""WITH c AS (SELECT p_partkey, p_partkey * 7919 % 256 AS r, p_partkey * 104729 % 256 AS g, p_size * 5 % 256 AS b FROM part), l AS (SELECT p_partkey, [CASE WHEN v / 255.0::DOUBLE <= 0.04045::DOUBLE THEN v / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((v / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END for v in [r, g, b]] AS x FROM c),
 y AS (SELECT p_partkey, 0.2126::DOUBLE * x[1] + 0.7152::DOUBLE * x[2] + 0.0722::DOUBLE * x[3] AS y FROM l) SELECT p_partkey, round(1.05::DOUBLE / (y + 0.05::DOUBLE), 6) AS ratio, 1.05::DOUBLE / (y + 0.05::DOUBLE) >= 4.5 AS readable, round(CASE WHEN y > 216.0::DOUBLE / 24389 THEN 116 * cbrt(y) - 16 ELSE y * 24389.0::DOUBLE / 27 END, 6) AS lightness FROM y""")
def contrast_ratio(spark, sf_dir):
    """Made-up colours against white."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 256).alias("r"), (F.col("p_partkey") * 104729 % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("b"))
    y = S.luminance(F.col("r"), F.col("g"), F.col("b"))
    ratio = S.contrast(F.lit(1.0), y)
    return p.select("p_partkey", F.round(ratio, 6).alias("ratio"), (ratio >= 4.5).alias("readable"), F.round(S.lightness(y), 6).alias("lightness"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
 CASE WHEN s % 100 BETWEEN 11 AND 14 THEN 'кадров' WHEN s % 10 = 1 THEN 'кадр' WHEN s % 10 BETWEEN 2 AND 4 THEN 'кадра' ELSE 'кадров' END AS word FROM (SELECT event_id, CAST(round_even(value * 20, 0) AS BIGINT) AS s FROM events)""")
def clock_and_plural(spark, sf_dir):
    """X3, X5."""
    s = F.bround(F.col("value") * 20, 0).cast("long")
    return table(spark, sf_dir, "events").select("event_id", S.clock(F.col("value") * 20).alias("clock"), S.plural(s, "кадр", "кадра", "кадров").alias("word"))


@query("""SELECT event_id, try_strptime(CASE WHEN event_id % 9 = 0 THEN 'garbage' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END, '%Y:%m:%d %H:%M:%S') IS NOT NULL AS ok,
 round(epoch_us(try_strptime(CASE WHEN event_id % 9 = 0 THEN 'garbage' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END, '%Y:%m:%d %H:%M:%S')) / 1e6 + CAST('0.' || CAST(event_id % 100 AS VARCHAR) AS DOUBLE), 3) AS t FROM events""")
def exif_time(spark, sf_dir):
    """X1, S24."""
    e = table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 9 == 0, "garbage").otherwise(F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit("-"), F.lit(":")))
    t = S.exif_seconds(stamp, (F.col("event_id") % 100).cast("string"))
    return e.select("event_id", t.isNotNull().alias("ok"), F.round(t, 3).alias("t"))


@query("SELECT p_partkey, CASE WHEN starts_with(lower(p_type), lower(p_name)) THEN p_type ELSE trim(p_name || ' ' || p_type) END AS camera, CASE WHEN p_retailprice * 1000 >= 1048576 THEN printf('%.1f МБ', p_retailprice * 1000 / 1048576.0::DOUBLE) ELSE CAST(CAST(round_even(p_retailprice * 1000 / 1024.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || ' КБ' END AS size FROM part")
def camera_and_size(spark, sf_dir):
    """X4, X6."""
    return table(spark, sf_dir, "part").select("p_partkey", S.camera(F.col("p_name"), F.col("p_type")).alias("camera"), S.byte_size(F.col("p_retailprice") * 1000).alias("size"))


@query(f"WITH {FRAMES_SQL}, x AS (SELECT *, CASE WHEN sharpness < 5 THEN ['soft'] ELSE [] END || CASE WHEN k % 4 = 0 THEN ['no_face'] ELSE [] END || CASE WHEN k % 7 = 0 THEN ['odd'] ELSE [] END AS flags FROM frames) SELECT frame_id, array_to_string(flags, ',') AS flags, CAST((CASE WHEN list_contains(flags, 'soft') THEN 4 ELSE 0 END) + (CASE WHEN list_contains(flags, 'no_face') THEN 1 ELSE 0 END) AS INT) AS penalty FROM x")
def flag_penalties(spark, sf_dir):
    """P3, X19, J13."""
    flags = F.array_compact(F.array(F.when(F.col("sharpness") < 5, "soft"), F.when(F.col("k") % 4 == 0, "no_face"), F.when(F.col("k") % 7 == 0, "odd")))
    df = frames(spark, sf_dir).withColumn("_f", flags)
    return df.select("frame_id", F.array_join("_f", ",").alias("flags"), S.penalty(F.col("_f"), {"unreadable": 100, "soft": 4, "blown_face": 2, "dark_face": 2, "no_face": 1}).alias("penalty"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o BETWEEN 5 AND 8 AND (w < h) <> (rw < rh) AND w <> h AND rw <> rh THEN 1 ELSE o END AS orientation FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 8 + 1 AS INT) AS o, l_quantity AS w, l_discount * 300 AS h, l_suppkey AS rw, l_linenumber AS rh FROM lineitem)")
def orientation_guard(spark, sf_dir):
    """P13."""
    df = table(spark, sf_dir, "lineitem")
    o = (F.col("l_partkey") % 8 + 1).cast("int")
    return df.select("l_orderkey", "l_linenumber", S.orientation_to_apply(o, F.col("l_quantity"), F.col("l_discount") * 300, F.col("l_suppkey"), F.col("l_linenumber")).alias("orientation"))


@query(f"WITH {FRAMES_SQL}, a AS (SELECT shoot_id, list(sharpness ORDER BY sharpness) AS x, round(quantile_cont(sharpness, 0.97), 6) AS p97, round(avg(CASE WHEN sharpness >= 40 THEN 1.0::DOUBLE ELSE 0 END), 9) AS clipped FROM frames GROUP BY 1) SELECT shoot_id, x[CAST(least(len(x) - 1, floor(0.9::DOUBLE * len(x))) AS BIGINT) + 1] AS p90, p97, clipped FROM a")
def pixel_percentiles(spark, sf_dir):
    """A13 (nearest index), A14 (interpolated), A15 (share)."""
    df = frames(spark, sf_dir).groupBy("shoot_id").agg(F.sort_array(F.collect_list("sharpness")).alias("x"), F.round(F.percentile("sharpness", F.lit(0.97)), 6).alias("p97"), F.round(F.avg((F.col("sharpness") >= 40).cast("double")), 9).alias("clipped"))
    return df.select("shoot_id", F.expr("element_at(x, int(least(size(x) - 1, floor(double(0.9) * size(x)))) + 1)").alias("p90"), "p97", "clipped")


@query("SELECT c_nationkey, round(corr(ra, rb), 9) AS spearman FROM (SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS DOUBLE) AS ra, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment), c_custkey) AS DOUBLE) AS rb FROM customer) GROUP BY 1")
def spearman(spark, sf_dir):
    """Rank correlation, ties by id."""
    w = Window.partitionBy("c_nationkey")
    df = table(spark, sf_dir, "customer").select("c_nationkey", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")).cast("double").alias("a"), F.row_number().over(w.orderBy(F.length("c_mktsegment"), "c_custkey")).cast("double").alias("b"))
    return df.groupBy("c_nationkey").agg(F.round(F.corr("a", "b"), 9).alias("spearman"))


@query("SELECT c_mktsegment, CASE WHEN count(DISTINCT c_nationkey) = 1 THEN min(c_nationkey) END AS common, count(*) AS n FROM customer GROUP BY 1")
def common_folder(spark, sf_dir):
    """A19."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.when(F.min("c_nationkey") == F.max("c_nationkey"), F.min("c_nationkey")).alias("common"), F.count("*").alias("n"))


@query("SELECT source, arg_max(len_, struct_pack(n := n, o := -len_)) AS modal, max(n) AS n FROM (SELECT source, n_chars // 100 AS len_, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def modal_value(spark, sf_dir):
    """F16: the commonest value, the smallest of equals."""
    df = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("n_chars") / 100).alias("v")).agg(F.count("*").alias("n"))
    return df.groupBy("source").agg(F.max_by("v", F.struct("n", (-F.col("v")).alias("o"))).alias("modal"), F.max("n").alias("n"))


@query("SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS alpha, count(*) AS n FROM part GROUP BY ALL")
def screen_accuracy(spark, sf_dir):
    """A18."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("alpha"), F.count("*").alias("n"))


@query("SELECT l_suppkey, least(34, greatest(12, max(length(CAST(l_partkey AS VARCHAR)) * 5))) AS width FROM lineitem GROUP BY 1")
def column_widths(spark, sf_dir):
    """A21."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.least(F.lit(34), F.greatest(F.lit(12), F.max(F.length(F.col("l_partkey").cast("string")) * 5))).alias("width"))


@query(f"""WITH {FILES_SQL} SELECT dir AS out_dir, pos, path AS src, stem || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '.jpg' AS dst_name FROM (SELECT *, row_number() OVER (PARTITION BY dir, lower(stem) ORDER BY pos) AS k FROM files)""")
def planned_names(spark, sf_dir):
    """Names that don't collide, in input order. No stem here looks like a numbered one; the tests have those."""
    f = files(spark, sf_dir).select("pos", F.col("dir").alias("out_dir"), "stem", F.col("path").alias("src"))
    return P.plan_names(f)


@query(f"WITH {FRAMES_SQL} SELECT shoot_id, frame_id, event_type, penalty FROM frames WHERE event_type IN ('error', 'signup') AND NOT (k < 3)")
def only_problems(spark, sf_dir):
    """Predicates that reach the scan."""
    return frames(spark, sf_dir).where(F.col("event_type").isin("error", "signup") & ~(F.col("k") < 3)).select("shoot_id", "frame_id", "event_type", "penalty")


@query("SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS asked, max(length(text)) AS longest FROM conversations GROUP BY 1")
def conversation_totals(spark, sf_dir):
    """A2 on ordered turns."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max(F.length("text")).alias("longest"))


@query("SELECT page_id, CASE WHEN length(url) <= 24 THEN url ELSE left(url, 23) || '…' END AS shown FROM pages")
def elided_names(spark, sf_dir):
    """X9."""
    return table(spark, sf_dir, "pages").select("page_id", S.elided(F.col("url"), 24).alias("shown"))


@query("""SELECT p_partkey, greatest(2.5::DOUBLE, 4.0::DOUBLE * greatest((p_partkey % 4000 + 1)::DOUBLE / (p_size * 20), 1.0::DOUBLE)) AS pitch,
 CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE (p_size * (p_size + 1))::DOUBLE / (60 * (p_partkey % 7)) END AS share FROM part""")
def pitch_and_preview_share(spark, sf_dir):
    """X14, and the share of X7."""
    key, size = F.col("p_partkey"), F.col("p_size")
    share = S.preview_share(size, size + 1, F.lit(60), key % 7, key % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", S.display_pitch(key % 4000 + 1, size * 20).alias("pitch"), share.alias("share"))


@query(f"SELECT doc_id, md5({_FOLDED}) AS folded FROM (SELECT doc_id, text || 'Щука«ёж»' || chr(160) || '№' || chr(8722) || 'ъЯ…' AS text FROM documents)")
def ascii_text(spark, sf_dir):
    """Whole texts in plain letters and signs, with some of each behind them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.folded(F.concat("text", F.lit("Щука«ёж»\u00a0№\u2212ъЯ…")))).alias("folded"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'skipped' WHEN p_partkey % 7 = 0 THEN 'error'
 WHEN p_partkey % 5 = 0 OR (share > 0 AND share < 0.4) OR p_partkey % 13 = 0 THEN 'warn' ELSE 'ok' END AS tag FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS share FROM part)""")
def status_tags(spark, sf_dir):
    """X7, P6."""
    k = F.col("p_partkey")
    tag = S.status_tag(F.when(k % 7 == 0, "broken"), k % 11 == 0, k % 5 == 0, F.col("p_size") / 50.0, k % 13 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"))


@query("SELECT p_partkey, regexp_replace(f, '^(.*?[^ ])( (bold|regular|medium|semibold|light|black|italic))+$', '\\1', 'i') AS family, regexp_replace(lower(f), '[^\\p{L}\\p{N}]+', '', 'g') AS name_key FROM (SELECT p_partkey, p_brand || CASE p_partkey % 3 WHEN 0 THEN ' Bold' WHEN 1 THEN ' Light Italic' ELSE ' Sans' END AS f FROM part)")
def font_families(spark, sf_dir):
    """X22."""
    k = F.col("p_partkey") % 3
    f = F.concat("p_brand", F.when(k == 0, " Bold").when(k == 1, " Light  Italic").otherwise(" Sans"))
    return table(spark, sf_dir, "part").select("p_partkey", S.short_family(f).alias("family"), S.plain_key(f).alias("name_key"))


@query(f"WITH {FILES_SQL} SELECT path_key, count(*) AS n FROM (SELECT lower(dir || '/' || stem || '.' || ext) AS path_key FROM files) GROUP BY 1")
def path_keys(spark, sf_dir):
    """Spellings of one destination."""
    odd = F.concat("dir", F.when(F.col("pos") % 2 == 0, "//").otherwise("/./"), "stem", F.lit("."), "ext")
    return files(spark, sf_dir).groupBy(S.path_key(odd).alias("path_key")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(least(greatest(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0), 100) / 100, 0.6::DOUBLE) AS strength, 1.0::DOUBLE AS missing FROM events")
def settings_values(spark, sf_dir):
    """Settings from JSON with defaults and limits."""
    return table(spark, sf_dir, "events").select("event_id", S.share_setting(F.col("props"), "k", 0.6).alias("strength"), S.share_setting(F.col("props"), "nothing", 1.0).alias("missing"))


@query("""SELECT event_id, round(CASE WHEN m < 0.001 THEN 0.6::DOUBLE * 2 ELSE least(greatest((goal - m) / (m * (1 - goal)), -0.15::DOUBLE), 2.0::DOUBLE) END, 9) AS lift, round(t * t * (3 - 2 * t), 9) AS eased FROM
 (SELECT event_id, m, m + (least(greatest(m, 0.46::DOUBLE), 0.58::DOUBLE) - m) * 0.6::DOUBLE AS goal, least(greatest((m - 0.2::DOUBLE) / 0.6::DOUBLE, 0), 1) AS t FROM (SELECT event_id, value / (value + 10) AS m FROM events))""")
def exposure_parameters(spark, sf_dir):
    """X18."""
    m = F.col("value") / (F.col("value") + 10)
    return table(spark, sf_dir, "events").select("event_id", F.round(S.exposure(m, F.lit(0.6)), 9).alias("lift"), F.round(S.smoothstep(m, 0.2, 0.8), 9).alias("eased"))


@query("""WITH s AS (SELECT p_partkey, (p_partkey % 900 + 100)::DOUBLE AS w, (p_size * 13 + 50)::DOUBLE AS h, p_partkey % 4 <> 0 AS faced FROM part),
 c AS (SELECT *, least(w, h * 16 / 9) AS cw0, least(h, w / (16.0::DOUBLE / 9)) AS ch0, w * 0.4::DOUBLE AS fl, w * 0.4::DOUBLE + h / 9 AS fr, h * 0.2::DOUBLE AS ft, h * 0.5::DOUBLE AS fb FROM s),
 z AS (SELECT *, CASE WHEN faced THEN least(least(greatest(cw0 / greatest((fr - fl) / 0.3::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE), 1.8::DOUBLE), greatest(1.0::DOUBLE, 0.6::DOUBLE * cw0 / greatest(fr - fl, 1.0::DOUBLE))) ELSE 1.0::DOUBLE END AS zoom FROM c),
 n AS (SELECT *, cw0 / zoom AS cw, ch0 / zoom AS ch FROM z),
 q AS (SELECT *, CASE WHEN faced THEN CASE WHEN fr - fl <= cw THEN least(greatest((fl + fr) / 2 - cw / 2, fr - cw), fl) ELSE (fl + fr) / 2 - cw / 2 END ELSE 0.5::DOUBLE * w - cw / 2 END AS px,
 CASE WHEN faced THEN CASE WHEN fb - ft <= ch THEN least(greatest((ft + fb) / 2 - 0.4::DOUBLE * ch, fb - ch), ft) ELSE (ft + fb) / 2 - 0.4::DOUBLE * ch END ELSE 0.42::DOUBLE * h - ch / 2 END AS py FROM n),
 r AS (SELECT p_partkey, w, h, cw, ch, least(greatest(px, 0), w - cw) AS x, least(greatest(py, 0), h - ch) AS y FROM q)
 SELECT p_partkey, CAST(round_even(x, 0) AS INT) AS x0, CAST(round_even(y, 0) AS INT) AS y0, CAST(round_even(least(x + cw, w), 0) AS INT) AS x1, CAST(round_even(least(y + ch, h), 0) AS INT) AS y1 FROM r""")
def crop_boxes(spark, sf_dir):
    """A wide block's part of a frame, around the face if there is one."""
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 900 + 100).cast("double").alias("w"), (F.col("p_size") * 13 + 50).cast("double").alias("h"))
    w, h = F.col("w"), F.col("h")
    face = F.when(F.col("p_partkey") % 4 != 0, F.struct((w * 0.4).alias("left"), (h * 0.2).alias("top"), (w * 0.4 + h / 9).alias("right"), (h * 0.5).alias("bottom")))
    df = df.select("p_partkey", L.cover_crop(w, h, F.lit(16), F.lit(9), face, fill=0.3, most=1.8).alias("b"))
    return df.select("p_partkey", F.col("b.left").alias("x0"), F.col("b.top").alias("y0"), F.col("b.right").alias("x1"), F.col("b.bottom").alias("y1"))


_WORDS = r"""regexp_extract_all(p, '[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"""


@query(f"""WITH p AS (SELECT doc_id, i, {{'n': 0::BIGINT, 'widest': 0::BIGINT, 'line': 0::BIGINT}} AS none,
  flatten([CASE WHEN length(w) <= 60 THEN [{{'n': length(w)::BIGINT, 'widest': 1::BIGINT, 'line': 0::BIGINT}}] ELSE [{{'n': length(x)::BIGINT, 'widest': CASE WHEN k = 1 THEN 1::BIGINT ELSE 0::BIGINT END, 'line': 0::BIGINT}} for x, k in
   regexp_extract_all(w, '^-[^-]*(?:-+$|-|$)|[^-]+(?:-+$|-|$)|-+')] END for w in {_WORDS}]) AS parts FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
 f AS (SELECT doc_id, list_max([x.n for x in parts]) > 60 AS wide, list_reduce(parts, lambda a, x: CASE WHEN a.line = 0 THEN {{'n': 1::BIGINT, 'widest': greatest(a.widest, x.n), 'line': x.n}}
  WHEN a.line + x.widest + x.n <= 60 THEN {{'n': a.n, 'widest': greatest(a.widest, a.line + x.widest + x.n), 'line': a.line + x.widest + x.n}} ELSE {{'n': a.n + 1, 'widest': greatest(a.widest, x.n), 'line': x.n}} END, none) AS r FROM p)
 SELECT doc_id, CASE WHEN NOT bool_or(coalesce(wide, false)) THEN sum(r.n) END::INT AS n_lines, CASE WHEN NOT bool_or(coalesce(wide, false)) THEN max(r.widest) END::INT AS widest FROM f GROUP BY 1""")
def wrapped_texts(spark, sf_dir):
    """Whole texts in lines of 60 characters. In the SQL a part is its width, whether a blank stands before it, and the fold's line."""
    return wrapping.wrap_texts(table(spark, sf_dir, "documents"), "doc_id", 60)


def _pictures(spark, sf_dir):
    """``embeddings`` as frames of 8 x 8: a value is a pixel, whose channels differ a little."""
    level = lambda x, k: F.least(F.greatest(F.floor((x.cast("double") + 0.5) * (230 + k)), F.lit(0)), F.lit(255))
    text = F.array_join(F.transform("embedding", lambda x: F.concat(*[F.lpad(F.hex(level(x, k)), 2, "0") for k in (0, 8, 16)])), "")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(text).alias("data"))


def _digested(df):
    return df.select("path", "h", "w", F.sha1("data").alias("pixels"), "error")


@query(None)
def processed_frames(spark, sf_dir):
    """Corrected, then darkened towards the corners."""
    return _digested(tone.process_frames(_pictures(spark, sf_dir), 0.6, filter_name="vignette"))


@query(None)
def screened_frames(spark, sf_dir):
    """Dots of one ink on paper."""
    paper, ink = [0.98, 0.95, 0.88], [0.6, 0.08, 0.2]
    return _digested(tone.over_frames(_pictures(spark, sf_dir), lambda rgb: halftone.halftone(rgb, 3.0, paper, ink)))


_LEVEL = "lpad(lower(to_hex(least(greatest(floor((embedding[{i}]::DOUBLE + 0.5) * {m}), 0), 255)::BIGINT)), 2, '0')"
_TURNED = "CASE o WHEN 2 THEN y * 8 + 7 - x WHEN 3 THEN (7 - y) * 8 + 7 - x WHEN 4 THEN (7 - y) * 8 + x WHEN 5 THEN x * 8 + y WHEN 6 THEN (7 - x) * 8 + y WHEN 7 THEN (7 - x) * 8 + 7 - y WHEN 8 THEN x * 8 + 7 - y ELSE y * 8 + x END + 1"


@query(f"""SELECT vec_id::VARCHAR AS path, 8::INT AS h, 8::INT AS w, sha1(unhex(array_to_string(flatten([flatten([[{", ".join(_LEVEL.format(i=f"({_TURNED})", m=230 + k) for k in (0, 8, 16))}] for x in range(0, 8)]) for y in range(0, 8)]), ''))) AS pixels, NULL::VARCHAR AS error
 FROM (SELECT vec_id, embedding, vec_id % 8 + 1 AS o FROM embeddings)""")
def turned_frames(spark, sf_dir):
    """Pixels turned as their orientation says."""
    df = _pictures(spark, sf_dir).withColumn("orientation", (F.col("path").cast("long") % 8 + 1).cast("int"))
    return _digested(tone.over_frames(df, lambda rgb: rgb, turned=True))


def _camera_files(spark, sf_dir):
    """``pages`` as CR2 files in one folder each three; every eleventh is cut off."""
    from ..sources import fixture

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [{"path": f"d{r['page_id'] // 3}/IMG_{r['page_id']}.CR2", "content": fixture.cr2_file(320 + r["page_id"] % 50, 200 + r["page_id"] % 30, r["mark"].encode(), r["page_id"] % 8 + 1, "<>"[r["page_id"] % 2], r["page_id"] % 600, b"n" * (r["page_id"] * 997 % 20_000 + r["page_id"] % 2 * 70_000), 0.2 if r["page_id"] % 11 == 0 else 1.0)} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    made = table(spark, sf_dir, "pages").select("page_id", F.md5("url").alias("mark")).mapInArrow(run, "path string, content binary")
    return made.withColumn("dst_name", F.concat(F.regexp_extract("path", "(IMG_[0-9]+)", 1), F.lit(".jpg")))


_OF = "CASE WHEN page_id % 11 <> 0 THEN {} END"


@query(f"""SELECT page_id, page_id % 11 <> 0 AS ok, CASE WHEN page_id % 11 = 0 THEN 'raw' ELSE 'lossless' END AS mode, {_OF.format("'ifd0'")} AS source, {_OF.format("(320 + page_id % 50)::INT")} AS width, {_OF.format("(200 + page_id % 30)::INT")} AS height,
 {_OF.format("(page_id % 8 + 1)::INT")} AS orientation, {_OF.format("sha1(unhex('ffda000c03010002000300003f00') || encode(md5(url)) || unhex('ffd9'))")} AS scan, {_OF.format("(page_id % 2)::INT")} AS dropped FROM pages""")
def converted_previews(spark, sf_dir):
    """S10, S22, T-2, T-7, S28, O1, O3, O4, O6: a CR2 file a page, every eleventh cut off; the scan must come out byte for byte."""
    got = V.convert_files(_camera_files(spark, sf_dir)).withColumn("page_id", F.regexp_extract("path", "IMG_([0-9]+)", 1).cast("long"))
    scan = F.expr("substring(data, octet_length(data) - 47, 48)")
    dropped = F.when(F.col("ok"), F.exists("notes", lambda n: n == "tag 0x927c left out").cast("int"))
    return got.select("page_id", "ok", "mode", "source", "width", "height", "orientation", F.sha1(scan).alias("scan"), dropped.alias("dropped"))


@query("SELECT page_id, 'ifd0' AS source, md5(url) AS mark FROM pages WHERE page_id % 11 <> 0")
def preview_slices(spark, sf_dir):
    """S10, T-2, S22 as expressions: the probe's best preview, cut out of the file."""
    from ..sources import cr2

    files_ = _camera_files(spark, sf_dir)
    found = cr2.probe_files(files_).where("error is null").select("path", V.best_preview(F.col("previews")).alias("p"))
    cut = files_.join(found, "path").withColumn("stream", V.preview_bytes(F.col("content"), F.col("p")))
    return cut.select(F.regexp_extract("path", "IMG_([0-9]+)", 1).cast("long").alias("page_id"), "p.source", F.expr("cast(substring(stream, octet_length(stream) - 33, 32) as string)").alias("mark"))


@query("""SELECT page_id, CASE WHEN regexp_matches(s, '[\\\\/:*?"<>|]') THEN 'reserved' WHEN s LIKE '% ' AND trim(s, ' .') <> '' THEN 'edge' END AS problem, left(trim(trim(regexp_replace(s, '[\\\\/:*?"<>|]', '', 'g')), ' .'), 40) AS cleaned
 FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN substr(md5(url), 1, 12) || '. ' ELSE '_' || md5(url) || md5(url) END AS s FROM pages)""")
def suffixes(spark, sf_dir):
    """Whether a text can follow a stem, and what is left of it if it must."""
    k = F.col("page_id") % 3
    p = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.substring(F.md5("url"), 1, 12), F.lit(". "))).otherwise(F.concat(F.lit("_"), F.md5("url"), F.md5("url"))).alias("s"))
    return p.select("page_id", S.suffix_problem(F.col("s")).alias("problem"), S.clean_suffix(F.col("s")).alias("cleaned"))


@query("""WITH f AS (SELECT p_brand AS template, p_type AS key, p_size % 2 AS label, min(p_name) AS example FROM part GROUP BY ALL), s AS (SELECT p_brand AS template, p_type AS key, nullif(max(p_name), 'x') AS value FROM part WHERE p_brand < 'Brand#3' GROUP BY ALL),
 c AS (SELECT p_type AS key, 1 AS label, CASE WHEN count(*) % 2 = 0 THEN max(p_name) ELSE ' ' END AS value FROM part GROUP BY 1)
 SELECT f.template, f.key, f.label, coalesce(CASE WHEN f.template IN (SELECT template FROM s) THEN s.value WHEN trim(c.value) <> '' THEN c.value END, f.example, '') AS value FROM f LEFT JOIN s ON s.template = f.template AND s.key = f.key LEFT JOIN c ON c.key = f.key AND c.label = f.label""")
def carried_fields(spark, sf_dir):
    """A template's fields, saved or carried over by key and label."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("template"), F.col("p_type").alias("key"), (F.col("p_size") % 2).alias("label"), "p_name")
    fields = p.groupBy("template", "key", "label").agg(F.min("p_name").alias("example"))
    saved = p.where("template < 'Brand#3'").groupBy("template", "key").agg(F.max("p_name").alias("value"))
    current = p.groupBy("key").agg(F.when(F.count("*") % 2 == 0, F.max("p_name")).otherwise(" ").alias("value")).withColumn("label", F.lit(1))
    return R.carry_over(fields, current, saved)


@query("""SELECT doc_id, source FROM documents WHERE lower(source || doc_id % 500) IN (SELECT lower('Src' || doc_id) FROM labels) OR lower(source || doc_id % 500) IN (SELECT lower(source || doc_id) FROM documents WHERE doc_id % 5 = 0)
 QUALIFY row_number() OVER (PARTITION BY lower(source || doc_id % 500) ORDER BY doc_id DESC) = 1""")
def saved_ticks(spark, sf_dir):
    """Saved names whatever their case, unknown ones dropped, the last of equal names."""
    d = table(spark, sf_dir, "documents")
    items = d.select("doc_id", "source", F.concat("source", (F.col("doc_id") % 500).cast("string")).alias("name"))
    saved = d.where("doc_id % 5 = 0").select(F.upper(F.concat("source", F.col("doc_id").cast("string"))).alias("name")).union(table(spark, sf_dir, "labels").select(F.concat(F.lit("Src"), F.col("doc_id").cast("string"))))
    return R.saved_ticks(items, saved, pos="doc_id").select("doc_id", "source")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ORDER BY o_custkey = (SELECT min(o_custkey) FROM orders) DESC, o_orderkey DESC LIMIT 40")
def retained_folders(spark, sf_dir):
    """T-8: the forty saved last, and always the current one."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return R.retained(o, "o_custkey", "o_orderkey", o.agg(F.min("o_custkey")).first()[0])


@query(f"""WITH {FILES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY pos) AS n FROM files), w AS (SELECT *, row_number() OVER (PARTITION BY lower(stem), dir ORDER BY pos) AS m FROM k)
 SELECT pos, path AS src, stem || CASE WHEN n = 1 THEN '' WHEN m = 1 OR (m = 2 AND n = 2) THEN '_' || dir ELSE '_' || (n - CASE WHEN n > 2 THEN 1 ELSE 0 END) END || '.jpg' AS dst_name FROM w""")
def converter_names(spark, sf_dir):
    """K5, the converter's policy: all into one folder, so frames of one name get their folder's name, then numbers."""
    f = files(spark, sf_dir).select("pos", F.lit("out").alias("out_dir"), "stem", F.col("path").alias("src"))
    return P.plan_names(f, policy="telling", shared=True).select("pos", "src", "dst_name")


@query(f"""WITH {PORTRAITS_SQL}, cand AS (SELECT *, x > 2 AND y > 2 AND x + s < 638 AND y + s < 430 AS inner_, s * s * (1 - 0.6::DOUBLE * least(sqrt(pow((x + s / 2.0::DOUBLE) / 640 - 0.5::DOUBLE, 2) + pow((y + s / 2.0::DOUBLE) / 432 - 0.5::DOUBLE, 2)), 1)) AS v FROM faces WHERE s >= 32),
 subj AS (SELECT * FROM (SELECT *, bool_or(inner_) OVER (PARTITION BY frame_id) AS any_ FROM cand) WHERE inner_ OR NOT any_ QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY v DESC, k) = 1)
 SELECT f.frame_id, row_number() OVER (PARTITION BY f.frame_id ORDER BY CASE WHEN j.k = f.k THEN 0 ELSE 1 END, f.s DESC, f.k) - 1 AS nth, round(f.x / 640.0::DOUBLE, 9) AS x, round(f.y / 432.0::DOUBLE, 9) AS y, round(f.s / 640.0::DOUBLE, 9) AS w FROM faces f LEFT JOIN subj j USING (frame_id)""")
def ordered_faces(spark, sf_dir):
    """a frame's faces, the subject first."""
    df = portraits(spark, sf_dir).select("frame_id", F.posexplode(S.faces_in_order(F.col("faces"), F.col("w"), F.col("h"))).alias("nth", "f"))
    return df.select("frame_id", "nth", *[F.round(f"f.{c}", 9).alias(c) for c in "xyw"])
