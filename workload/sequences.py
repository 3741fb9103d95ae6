"""Bindings of sequence, augmentation and streaming operators."""

from pyspark.sql import functions as F

from boutwise.operators import augment as AU
from boutwise.operators import features as FE
from boutwise.operators import sequences as SQ
from boutwise.streaming import incremental as ST

from .base import BOUTS, EMB, SAMPLES, bouts, embeddings, query, rounded, samples, table
from .features import IDS

SEQ = "sq AS (SELECT user_id, event_type AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS pos FROM events)"
CHAIN = f"""{SEQ}, tr AS (SELECT l AS prev, nx AS next, count(*) AS n FROM (SELECT l, lead(l) OVER (PARTITION BY user_id ORDER BY pos) AS nx FROM sq) WHERE nx IS NOT NULL GROUP BY ALL),
tp AS (SELECT *, n/sum(n) OVER (PARTITION BY prev) AS p FROM tr), st AS (SELECT l AS state, count(*) AS n, count(*)/(SELECT count(*) FROM sq)::DOUBLE AS p FROM sq GROUP BY l),
g3 AS (SELECT l AS a, lead(l,1) OVER w AS b, lead(l,2) OVER w AS c FROM sq WINDOW w AS (PARTITION BY user_id ORDER BY pos)), mo AS (SELECT a, b, c, count(*) AS n FROM g3 WHERE c IS NOT NULL GROUP BY ALL),
mf AS (SELECT *, sum(n) OVER () AS windows, n/sum(n) OVER () AS f FROM mo),
ex AS (SELECT mf.*, st.p*x.p*y.p AS e FROM mf JOIN st ON st.state=a JOIN tp x ON x.prev=a AND x.next=b JOIN tp y ON y.prev=b AND y.next=c)"""


def event_sequence(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return SQ.positions(e, ["user_id"], ["us", "event_id"], F.floor(F.col("us") / F.lit(86400000000)))


def named(df):
    return df.withColumn("motif", F.array_join("motif", ">"))


@query("seq_1_transitions", f"WITH {CHAIN} SELECT prev, next, n, round(p,6) AS p FROM tp")
def _(spark, d):
    return rounded(SQ.transitions(event_sequence(spark, d), ["user_id"], "event_type"))


@query("seq_1_role_transitions", "WITH t AS (SELECT role AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations), c AS (SELECT prev, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY ALL) SELECT prev, next, n, round(n/sum(n) OVER (PARTITION BY prev),6) AS p FROM c")
def _(spark, d):
    c = SQ.positions(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024))
    return rounded(SQ.transitions(c, ["conv_id"], "role"))


@query("seq_1_start_distribution", f"WITH {CHAIN} SELECT state, n, round(p,6) AS p FROM st")
def _(spark, d):
    return rounded(SQ.start_distribution(event_sequence(spark, d), "event_type"))


def motif_table(spark, d):
    s = event_sequence(spark, d)
    return SQ.expected_frequency(SQ.motifs(s, ["user_id"], "event_type", 3), SQ.transitions(s, ["user_id"], "event_type"), SQ.start_distribution(s, "event_type"))


@query("seq_2_expected_frequency", f"WITH {CHAIN} SELECT a||'>'||b||'>'||c AS motif, round(e,8) AS expected FROM ex")
def _(spark, d):
    return named(motif_table(spark, d)).select("motif", F.round("expected", 8).alias("expected"))


@query("seq_3_motif_frequency", f"WITH {CHAIN} SELECT a||'>'||b||'>'||c AS motif, n, windows::BIGINT AS windows, round(f,6) AS frequency FROM mf")
def _(spark, d):
    return rounded(named(SQ.motifs(event_sequence(spark, d), ["user_id"], "event_type", 3)))


@query("seq_4_markov_score", f"WITH {CHAIN} SELECT a||'>'||b||'>'||c AS motif, round(2*windows*(f*ln(f/e)+(1-f)*ln((1-f)/(1-e)))/(1+(1/e+1/(1-e)-1)/(6.0*windows)),5) AS score FROM ex")
def _(spark, d):
    return named(SQ.markov_score(motif_table(spark, d), tail=False)).select("motif", F.round("score", 5).alias("score"))


@query("seq_4_markov_tail", None)
def _(spark, d):
    return rounded(named(SQ.markov_score(motif_table(spark, d))).select("motif", "neg_log10_p"))


TWO = f"""{SEQ}, h AS (SELECT user_id%2 AS side, l AS a, lead(l,1) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM sq), m AS (SELECT side, a||'>'||b AS motif, count(*)::DOUBLE AS n FROM h WHERE b IS NOT NULL GROUP BY ALL),
f AS (SELECT side, motif, n/sum(n) OVER (PARTITION BY side) AS f, sum(n) OVER (PARTITION BY side) AS w FROM m), x AS (SELECT * FROM f WHERE side=0), y AS (SELECT * FROM f WHERE side=1)"""


@query("seq_5_compare_usage", f"WITH {TWO} SELECT motif, round(x.f,6) AS frequency_a, round(y.f,6) AS frequency_b, round(2*y.w*(y.f*ln(y.f/x.f)+(1-y.f)*ln((1-y.f)/(1-x.f))),5) AS score FROM x JOIN y USING (motif)")
def _(spark, d):
    s = event_sequence(spark, d)
    a, b = (SQ.motifs(s.where(F.col("user_id") % 2 == i), ["user_id"], "event_type", 2) for i in (0, 1))
    r = named(SQ.compare_usage(a, b))
    return rounded(r.withColumn("score", F.round("score", 5)), "frequency_a", "frequency_b")


@query("seq_6_mixture_entropy", f"""WITH {EMB}, y AS (SELECT vec_id, list_transform(e[1:4], lambda x: abs(x)+0.1::DOUBLE) AS y FROM emb), u AS (SELECT vec_id, unnest(range(4)) AS i, unnest(y) AS v, list_sum(y) AS s FROM y), p AS (SELECT i, avg(v/s) AS p FROM u GROUP BY i), q AS (SELECT vec_id, sum(v*p) AS q FROM u JOIN p USING (i) GROUP BY vec_id)
SELECT round(avg(-q*ln(q+1e-15)),6) AS entropy FROM q""")
def _(spark, d):
    y = embeddings(spark, d).select(F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")) + 0.1).alias("y"))
    return rounded(SQ.mixture_entropy(y, "y", 4))


# ---- augmentation ------------------------------------------------------------------------------

H = lambda what, view: f"('0x'||substr(md5(sd||':{view}:{what}'),1,8))::BIGINT"
VIEW = f"""{BOUTS}, sb AS (SELECT fish_id, bout_index, n, 11+(fish_id*1000+bout_index)*97 AS sd, floor(n*0.25::DOUBLE)::BIGINT AS top FROM bouts),
v1 AS (SELECT *, CASE WHEN top>0 THEN 1+{H('len', 'a')} % greatest(top,1) ELSE 0 END AS size0 FROM sb),
vw AS (SELECT fish_id, bout_index, n, {H('start', 'a')} % (n-size0+1) AS a_start, CASE WHEN {H('block', 'a')}/4294967296.0::DOUBLE < 0.5 THEN size0 ELSE 0 END AS a_size,
 CASE WHEN {H('mask', 'a')}/4294967296.0::DOUBLE < 0.25 THEN CASE WHEN {H('group', 'a')} % 2 = 0 THEN 'orientation' ELSE 'speed' END END AS a_group FROM v1),
ms AS (SELECT s.fish_id, s.bout_index, s.pos, w.n, w.a_group, s.pos>=a_start AND s.pos<a_start+a_size AS blk, sin(heading)::FLOAT::DOUBLE AS sn, cos(heading)::FLOAT::DOUBLE AS cs, speed::FLOAT::DOUBLE AS sp FROM samples s JOIN vw w USING (fish_id, bout_index)),
ch AS (SELECT fish_id, bout_index, n, (CASE WHEN coalesce(a_group='orientation',false) OR blk THEN abs(sn) ELSE 0 END) AS d0, (CASE WHEN coalesce(a_group='orientation',false) OR blk THEN abs(cs) ELSE 0 END) AS d1, (CASE WHEN coalesce(a_group='speed',false) OR blk THEN abs(sp) ELSE 0 END) AS d2 FROM ms),
vm AS (SELECT fish_id, bout_index, sum((d0<>0)::INT+(d1<>0)::INT+(d2<>0)::INT)::BIGINT AS changed_elements, sum((d0<>0)::INT+(d1<>0)::INT+(d2<>0)::INT)/(3.0::DOUBLE*any_value(n)) AS changed_element_fraction, count_if(d0<>0 OR d1<>0 OR d2<>0)::BIGINT AS changed_steps,
 count_if(d0<>0 OR d1<>0 OR d2<>0)/any_value(n)::DOUBLE AS changed_step_fraction, sum(d0+d1+d2)/(3.0::DOUBLE*any_value(n)) AS mean_abs_change, greatest(max(d0),max(d1),max(d2)) AS max_abs_change FROM ch GROUP BY fish_id, bout_index)"""
CONFIG = AU.ViewConfig(temporal_fraction=0.25)


def views(spark, d):
    m = FE.model_input(bouts(spark, d), IDS)
    return AU.two_views(m, AU.view_seed(11, 0, F.col("fish_id") * 1000 + F.col("bout_index")), CONFIG)


@query("aug_1_temporal_mask", f"WITH {VIEW} SELECT fish_id, bout_index, a_start, a_size FROM vw")
def _(spark, d):
    return rounded(views(spark, d).select(*IDS, "a_start", "a_size"))


@query("aug_2_feature_mask", f"WITH {VIEW} SELECT fish_id, bout_index, a_group FROM vw")
def _(spark, d):
    return views(spark, d).select(*IDS, "a_group")


@query("aug_3_view_samples", f"WITH {VIEW}, o AS (SELECT s.fish_id, s.bout_index, s.pos, CASE WHEN coalesce(a_group='speed',false) OR (pos>=a_start AND pos<a_start+a_size) THEN 0 ELSE speed::FLOAT::DOUBLE END AS speed FROM samples s JOIN vw USING (fish_id, bout_index)) SELECT fish_id, bout_index, pos, round(speed,4) AS speed FROM o")
def _(spark, d):
    v = views(spark, d).select(*IDS, F.posexplode("speed_a").alias("pos", "speed"))
    return v.select(*IDS, F.col("pos").cast("bigint").alias("pos"), F.round(F.col("speed").cast("double"), 4).alias("speed"))


VM = ["changed_elements", "changed_element_fraction", "changed_steps", "changed_step_fraction", "mean_abs_change", "max_abs_change"]


@query("aug_4_view_metrics", f"WITH {VIEW} SELECT fish_id, bout_index, changed_elements, round(changed_element_fraction,6) AS changed_element_fraction, changed_steps, round(changed_step_fraction,6) AS changed_step_fraction, round(mean_abs_change,4) AS mean_abs_change, round(max_abs_change,4) AS max_abs_change FROM vm")
def _(spark, d):
    m = AU.view_metrics(views(spark, d), IDS, "a")
    m = m.withColumns({c: F.round(c, 4) for c in ("mean_abs_change", "max_abs_change")})
    return rounded(m, "changed_element_fraction", "changed_step_fraction")


@query("aug_4_metric_distribution", f"""WITH {VIEW}, u AS (SELECT unnest(['changed_elements','changed_step_fraction','mean_abs_change']) AS metric, unnest([changed_elements::DOUBLE, changed_step_fraction, mean_abs_change]) AS v FROM vm)
SELECT metric, round(min(v),4) AS min, round(avg(v),4) AS mean, round(max(v),4) AS max, round(quantile_cont(v,0.25),4) AS p25, round(median(v),4) AS median, round(quantile_cont(v,0.75),4) AS p75, round(quantile_cont(v,0.95),4) AS p95 FROM u GROUP BY metric""")
def _(spark, d):
    m = AU.metric_distribution(AU.view_metrics(views(spark, d), IDS, "a"), ["changed_elements", "changed_step_fraction", "mean_abs_change"])
    return m.select("metric", *[F.round(c, 4).alias(c) for c in m.columns if c != "metric"])


# ---- streaming ---------------------------------------------------------------------------------


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("str_1_running_moments", "SELECT user_id, count(value) AS n, round(avg(value),6) AS mean, round(var_pop(value),6) AS var FROM events GROUP BY 1")
def _(spark, d):
    return rounded(ST.run_to_table(ST.running_moments(event_stream(spark, d), "user_id", "value"), "complete", "moments"))


@query("str_1_overall_moments", "SELECT count(value) AS n, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std FROM events")
def _(spark, d):
    return rounded(ST.overall_moments(ST.run_to_table(ST.running_moments(event_stream(spark, d), "user_id", "value"), "complete", "moments")))


@query("str_2_online_intervals", """WITH e AS (SELECT user_id, epoch_us(ts)/1e6 AS t FROM events) SELECT user_id, round(t,6) AS start, round(t-lag(t) OVER (PARTITION BY user_id ORDER BY t),4) AS "interval", false AS late FROM e""")
def _(spark, d):
    at = F.col("ts").cast("timestamp")
    t = F.unix_micros(at) / 1e6
    e = event_stream(spark, d)
    s = e.select("user_id", at.alias("at"), t.alias("start"), t.alias("end"))
    # a heartbeat long after the last event, so that the watermark passes all of them
    none = F.lit(None).cast("double")
    beat = e.where("event_id = 0").select("user_id", F.lit("2200-01-01").cast("timestamp").alias("at"), none.alias("start"), none.alias("end"))
    r = ST.run_to_table(ST.online_intervals(s.union(beat), "user_id", "at", "1 hour"), "append", "intervals")
    return r.select("user_id", F.round("start", 6).alias("start"), F.round("interval", 4).alias("interval"), "late")
