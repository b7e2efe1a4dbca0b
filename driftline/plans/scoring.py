"""Labels, ranking metrics, firing rules and sweeps over the event stream. The
score of a sample is a rule on its features, so that SQL can say it too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate, firing, joins, models, series, stats
from ..params import FiringRules
from ..shared import materialized
from .registry import DAY, EV, US, V, query, r, table
from .windows import DECISIONS, points

LEADS = [DAY * x for x in (1.0, 3.0, 5.0)]
LEAD_SQL = f"{DECISIONS}, l AS (SELECT r.*, e AS lead_s, coalesce(tau <= e, false)::INT AS yl, entity % 5 AS fold FROM ready r, (VALUES (86400.0::DOUBLE), (259200.0::DOUBLE), (432000.0::DOUBLE)) AS x(e))"


def _leads(ev: DataFrame) -> DataFrame:
    return evaluate.lead_labels(points(ev), LEADS).withColumn("fold", F.col("entity") % 5).withColumn("score", F.round("sd", 6))


@query("lead_time_label", f"{LEAD_SQL} SELECT event_id, lead_s, yl AS y FROM l")
def lead_time_label(ev: DataFrame) -> DataFrame:
    return _leads(ev).select("event_id", "lead_s", "y")


AUC = """, c AS (SELECT {by}, round(sd, 6) AS score, sum(yl) AS p, count(*) - sum(yl) AS n FROM l GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM c),
auc AS (SELECT {by}, sum(p + n)::BIGINT AS n, sum(p)::BIGINT AS positives, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p::DOUBLE * (u + n / 2)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) END AS auroc FROM k GROUP BY ALL)"""


@query("auroc", LEAD_SQL + AUC.format(by="lead_s") + " SELECT lead_s, n, positives, round(auroc, 9) AS auroc FROM auc")
def auroc(ev: DataFrame) -> DataFrame:
    return evaluate.auroc(_leads(ev), "score", "y", ["lead_s"]).select("lead_s", "n", "positives", r("auroc", 9).alias("auroc"))


@query("auprc", LEAD_SQL + """, c AS (SELECT lead_s, round(sd, 6) AS score, sum(yl)::BIGINT AS p, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY lead_s ORDER BY score DESC)) SELECT lead_s, round(CASE WHEN sum(p) > 0 THEN sum(p::DOUBLE * tp::DOUBLE / seen::DOUBLE) / sum(p)::DOUBLE END, 8) AS auprc FROM k GROUP BY 1""")
def auprc(ev: DataFrame) -> DataFrame:
    return evaluate.auprc(_leads(ev), "score", "y", ["lead_s"]).select("lead_s", r("auprc", 8).alias("auprc"))


FOLDS = LEAD_SQL + AUC.format(by="lead_s, fold")


SWEPT = [DAY * x for x in (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)]
CURVE = LEAD_SQL.replace("(VALUES (86400.0::DOUBLE), (259200.0::DOUBLE), (432000.0::DOUBLE)) AS x(e)", "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in SWEPT) + ") AS x(e)") + AUC.format(by="lead_s, fold")


@query("learnability_curve", CURVE + """, kp AS (SELECT *, sum(p) OVER w AS tp, sum(p + n) OVER w AS seen FROM c WINDOW w AS (PARTITION BY lead_s, fold ORDER BY score DESC)),
ap AS (SELECT lead_s, fold, CASE WHEN sum(p) > 0 THEN sum(p::DOUBLE * tp::DOUBLE / seen::DOUBLE) / sum(p)::DOUBLE END AS auprc FROM kp GROUP BY 1, 2)
SELECT lead_s, fold, n, positives, round(positives / n, 9) AS prevalence, round(auroc, 9) AS auroc, round(auprc, 8) AS auprc FROM auc JOIN ap USING (lead_s, fold)""")
def learnability_curve(ev: DataFrame) -> DataFrame:
    """Ten leads by five folds, ranked by a rule that SQL can state;
    ``learnability_models`` fits models."""
    rows = evaluate.lead_labels(points(ev), SWEPT).withColumn("fold", F.col("entity") % 5).withColumn("score", F.round("sd", 6))
    by = ["lead_s", "fold"]
    both = evaluate.auroc(rows, "score", "y", by).join(evaluate.auprc(rows, "score", "y", by), by)
    return both.select(*by, "n", "positives", r(F.col("positives") / F.col("n"), 9).alias("prevalence"), r("auroc", 9).alias("auroc"), r("auprc", 8).alias("auprc"))


def _read_average(ev: DataFrame) -> DataFrame:
    per = evaluate.auroc(_leads(ev), "score", "y", ["lead_s", "fold"]).withColumn("arm", F.lit("sd"))
    return evaluate.read_average(per, "auroc", ["arm"])


READ = FOLDS + ", pf AS (SELECT fold, avg(auroc) AS m FROM auc GROUP BY 1), ra AS (SELECT 'sd' AS arm, avg(m) AS mean, min(m) AS least FROM pf)"


@query("read_average", READ + " SELECT arm, round(mean, 8) AS mean, round(least, 8) AS least FROM ra")
def read_average(ev: DataFrame) -> DataFrame:
    return _read_average(ev).select("arm", r("mean", 8).alias("mean"), r("least", 8).alias("least"))


@query("pass_bar", READ + " SELECT arm, mean >= 0.65 AND least >= 0.6 AS passes FROM ra")
def pass_bar(ev: DataFrame) -> DataFrame:
    return evaluate.passes(_read_average(ev)).select("arm", "passes")


@query("comparability_stop", READ + " SELECT arm, mean BETWEEN 0.3 AND 0.69 AS comparable FROM ra")
def comparability_stop(ev: DataFrame) -> DataFrame:
    return evaluate.comparable(_read_average(ev), 0.3).select("arm", "comparable")


@query("paired_lift_verdict", LEAD_SQL + AUC.format(by="lead_s, fold") + ", l2 AS (SELECT lead_s, fold, yl, slope AS sd FROM l)" + AUC.format(by="lead_s, fold").replace("FROM l ", "FROM l2 ").replace(" c AS", " c2 AS").replace("FROM c)", "FROM c2)").replace(" k AS", " k2 AS").replace("FROM k ", "FROM k2 ").replace("auc AS (", "auc2 AS (") + """,
d AS (SELECT lead_s, b.auroc - a.auroc AS d FROM auc a JOIN auc2 b USING (lead_s, fold)), v AS (SELECT lead_s, count(d) AS folds, avg(d) AS lift, count(*) FILTER (d > 0) AS gains FROM d GROUP BY 1)
SELECT lead_s, folds, round(lift, 7) AS lift, gains, CASE WHEN lift >= 0.04 AND gains = folds THEN 'PASS' WHEN lift < 0.02 OR folds - gains >= 2 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM v""")
def paired_lift_verdict(ev: DataFrame) -> DataFrame:
    rows = _leads(ev)
    by = ["lead_s", "fold"]
    base = evaluate.auroc(rows, "score", "y", by).select(*by, F.col("auroc").alias("a"))
    treated = evaluate.auroc(rows.withColumn("score", F.round("slope", 6)), "score", "y", by).select(*by, F.col("auroc").alias("b"))
    return evaluate.lift_verdict(base.join(treated, by), "a", "b", ["lead_s"]).select("lead_s", "folds", r("lift", 7).alias("lift"), "gains", "verdict")


ARMS = {"lr_base": "sd", "lr_treated": "slope", "rf_base": "drop_vs_base", "rf_treated": "abs(slope)"}
BAR = "CASE WHEN {m}_lift >= 0.04 AND {m}_gains = folds THEN 'PASS' WHEN {m}_lift < 0.02 OR folds - {m}_gains >= 2 THEN 'FAIL' ELSE 'INCONCLUSIVE' END"


@query("treatment_verdict", LEAD_SQL + """, sz AS (SELECT entity FROM ev GROUP BY 1 HAVING count(*) >= 66), u AS (SELECT 'all' AS arm, * FROM l UNION ALL SELECT 'subset', * FROM l WHERE entity IN (SELECT entity FROM sz)),
v AS (SELECT arm, lead_s, fold, yl, s AS name, round(CASE s """ + " ".join(f"WHEN '{k}' THEN {x}" for k, x in ARMS.items()) + """ END, 6) AS score FROM u, (SELECT unnest(['lr_base', 'lr_treated', 'rf_base', 'rf_treated']) AS s)),
c AS (SELECT arm, name, lead_s, fold, score, sum(yl) AS p, count(*) - sum(yl) AS n FROM v GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY arm, name, lead_s, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS un FROM c),
auc AS (SELECT arm, name, lead_s, fold, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p::DOUBLE * (un + n / 2)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) END AS auroc FROM k GROUP BY 1, 2, 3, 4), pf AS (SELECT arm, name, fold, avg(auroc) AS m FROM auc GROUP BY 1, 2, 3),
pv AS (SELECT arm, fold, max(m) FILTER (name = 'lr_treated') - max(m) FILTER (name = 'lr_base') AS lr, max(m) FILTER (name = 'rf_treated') - max(m) FILTER (name = 'rf_base') AS rf FROM pf GROUP BY 1, 2),
d AS (SELECT arm, count(*) AS folds, avg(lr) AS lr_lift, count(*) FILTER (lr > 0) AS lr_gains, avg(rf) AS rf_lift, count(*) FILTER (rf > 0) AS rf_gains, avg(rf - lr) AS growth, count(*) FILTER (rf - lr > 0) AS growing FROM pv GROUP BY 1),
b AS (SELECT *, """ + BAR.format(m="lr") + " AS lr_verdict, " + BAR.format(m="rf") + """ AS rf_verdict FROM d)
SELECT round(a.lr_lift, 7) AS lr_lift, a.lr_gains, a.lr_verdict, round(a.rf_lift, 7) AS rf_lift, a.rf_gains, a.rf_verdict, round(a.growth, 7) AS growth, a.growing, round(s.lr_lift, 7) AS subset_lift, s.lr_verdict AS subset_verdict,
CASE WHEN a.lr_verdict = 'PASS' THEN 'PASS' WHEN a.rf_verdict = 'PASS' THEN 'INCONCLUSIVE (nonlinear signal)' ELSE a.lr_verdict END || CASE WHEN a.lr_verdict <> 'PASS' AND s.lr_verdict = 'PASS' THEN ' + INCONCLUSIVE (subset)' ELSE '' END AS verdict,
a.growth >= 0.03 AND a.growing >= 4 AS gap_grows FROM b a, b s WHERE a.arm = 'all' AND s.arm = 'subset'""")
def treatment_verdict(ev: DataFrame) -> DataFrame:
    """Both models and the subset of entities with long series; rules on the
    features stand for the models, so that SQL can say it."""
    long = ev.groupBy("entity").count().where("count >= 66").select("entity", F.lit(True).alias("long"))
    rows = _leads(ev).join(long, "entity", "left")
    arms = F.when(F.col("long"), F.array(F.lit("all"), F.lit("subset"))).otherwise(F.array(F.lit("all")))
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.round(F.expr(x), 6).alias("score")) for k, x in ARMS.items()])
    scored = rows.select("lead_s", "fold", "y", F.explode(arms).alias("arm"), named.alias("n")).select("lead_s", "fold", "y", "arm", F.explode("n").alias("n")).select("lead_s", "fold", "y", "arm", "n.*")
    areas = evaluate.auroc(scored, "score", "y", ["arm", "name", "lead_s", "fold"])
    per_fold = areas.groupBy("arm", "fold", "name").agg(F.avg("auroc").alias("m")).groupBy("arm", "fold").pivot("name", list(ARMS)).agg(F.first("m"))
    out = evaluate.treatment_verdict(per_fold)
    return out.withColumns({c: r(c, 7) for c in ("lr_lift", "rf_lift", "growth", "subset_lift")})


@query("train_winsorise", f"""{DECISIONS}, rf AS (SELECT *, entity % 5 AS fold FROM ready), b AS (SELECT x.fold, quantile_cont(sd, 0.005) AS lo, quantile_cont(sd, 0.995) AS hi FROM rf, (SELECT unnest(range(5)) AS fold) x WHERE rf.fold <> x.fold GROUP BY 1)
SELECT event_id, round(least(greatest(sd, lo), hi), 6) AS sd FROM rf JOIN b ON rf.fold = b.fold""")
def train_winsorise(ev: DataFrame) -> DataFrame:
    rows = points(ev).withColumn("fold", F.col("entity") % 5)
    return evaluate.winsorized(rows, evaluate.fold_bounds(rows, ["sd"], 5), ["sd"]).select("event_id", r("sd").alias("sd"))


@query("common_rows", f"{DECISIONS} SELECT event_id FROM ready WHERE tau IS NOT NULL")
def common_rows(ev: DataFrame) -> DataFrame:
    return points(ev).dropna(subset=["sd", "drop_vs_base", "slope", "tau"]).select("event_id")


@query("decision_mask", f"{EV}, x AS (SELECT *, (min(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY entity) - us)::DOUBLE / 1e6 AS tau_first FROM ev) SELECT event_id FROM x WHERE event_type <> 'error' AND (tau_first IS NULL OR tau_first > 0)")
def decision_mask(ev: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("event_type") == "error", US())).over(Window.partitionBy("entity"))
    marked = ev.withColumn("tau_first", (first - US()).cast("double") / series.S)
    return evaluate.first_event_only(marked, "tau_first").where("event_type <> 'error'").select("event_id")


@query("group_kfold")
def group_kfold(ev: DataFrame) -> DataFrame:
    folds = evaluate.group_folds(ev, "entity", 5)
    return ev.join(folds, "entity").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


FEATURE_NAMES = ["sd", "drop_vs_base", "slope"]
READ_LEADS = [DAY * x for x in (0.5, 1.0, 2.0, 3.0)]


def _pointed(ev: DataFrame, leads: list[float]) -> tuple[DataFrame, dict[str, float]]:
    """Decision points with a fold and a label for each lead, narrow and written."""
    rows = points(ev).withColumn("fold", F.col("entity") % 5).select("entity", "us", "fold", *FEATURE_NAMES, "tau")
    labelled, names = models.lead_targets(rows, leads)
    return materialized(labelled, "points"), names


def _areas(scored: DataFrame, names: dict[str, float], *by: str) -> DataFrame:
    """(by, lead_s, fold, n, positives, auroc) of scores by target."""
    lead = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("target"))
    return evaluate.auroc(scored.withColumn("lead_s", lead), "score", "y", [*by, "lead_s", "fold"])


@query("logreg_auroc")
def logreg_auroc(ev: DataFrame) -> DataFrame:
    rows, names = _pointed(ev, [3 * DAY])
    return _areas(models.logistic_scores(rows, {"all": FEATURE_NAMES}, list(names)), names).drop("lead_s")


@query("random_forest_auroc")
def random_forest_auroc(ev: DataFrame) -> DataFrame:
    rows, names = _pointed(ev, [3 * DAY])
    return _areas(models.forest_scores(rows, {"all": FEATURE_NAMES}, list(names)), names).drop("lead_s")


#: Forests of queries that fit dozens of them.
SMALL_FOREST = models.ForestRules(trees=50)
SHAPES = ["ac1", "curvature", "reversals"]


def _shaped(ev: DataFrame) -> DataFrame:
    """Decision points that have all shape features too, so that every set of
    features is measured on the same rows."""
    rows = series.lag1_autocorrelation(ev, "value", 7 * DAY, "ac1")
    rows = series.quadratic(series.reversal_rate(rows, "value", 7 * DAY, "reversals"), "value", 7 * DAY, "curvature", scale_s=DAY)
    return points(ev).join(rows.select("event_id", *SHAPES), "event_id").dropna(subset=SHAPES)


@query("learnability_models")
def learnability_models(ev: DataFrame) -> DataFrame:
    """The curve of fitted models, with both metrics: logistic regression over
    five folds at ten leads, and forests at the leads that are read.
    ``learnability_curve`` ranks by one feature, as its SQL says."""
    rows, names = _pointed(ev, SWEPT)
    read = [t for t, lead in names.items() if lead in READ_LEADS]
    sets = {"all": FEATURE_NAMES}
    linear = models.logistic_scores(rows, sets, list(names)).withColumn("model", F.lit("logistic"))
    forest = models.forest_scores(rows, sets, read, SMALL_FOREST).withColumn("model", F.lit("forest"))
    scored = materialized(linear.select("model", "target", "fold", "y", "score").unionByName(forest.select("model", "target", "fold", "y", "score")), "scored")
    lead = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("target"))
    by = ["model", "lead_s", "fold"]
    scored = scored.withColumn("lead_s", lead)
    return evaluate.auroc(scored, "score", "y", by).join(evaluate.auprc(scored, "score", "y", by), by)


@query("forward_selection")
def forward_selection(ev: DataFrame) -> DataFrame:
    """Greedy selection by the AUROC over five folds, averaged over the leads
    that are read; each round fits all its candidates at once."""
    features = [*FEATURE_NAMES, *SHAPES]
    rows, names = models.lead_targets(_shaped(ev).withColumn("fold", F.col("entity") % 5).select("fold", "tau", *features), READ_LEADS)
    rows = materialized(rows, "shaped")

    def read(sets: list[list[str]]) -> list[tuple[float, float]]:
        named = {str(k): columns for k, columns in enumerate(sets)}
        areas = _areas(models.logistic_scores(rows, named, list(names)), names, "name")
        found = {r["name"]: r for r in evaluate.read_average(areas, "auroc", ["name"]).collect()}  # a row a set
        return [(found[k]["mean"] or 0.0, found[k]["least"] or 0.0) if k in found else (0.0, 0.0) for k in named]

    kept = evaluate.forward_selection(features[1:], features[:1], read)
    return ev.sparkSession.createDataFrame([(k, c) for k, c in enumerate(kept)], "place int, feature string")


TREATED = {"base": FEATURE_NAMES, "treated": [*FEATURE_NAMES, *SHAPES]}


def _treatment_areas(ev: DataFrame) -> DataFrame:
    """(arm, model, fold, base, treated): the AUROC, averaged over the leads that
    are read, of models without and with shape features, on common rows. The
    arm ``subset`` has the entities with long series, and is linear only."""
    many = F.count("*").over(Window.partitionBy("entity"))
    long = ev.select("event_id", (many >= 66).alias("long"))
    rows = _shaped(ev).join(long, "event_id").withColumn("fold", F.col("entity") % 5).select("fold", "long", "tau", *TREATED["treated"])
    rows, names = models.lead_targets(rows, READ_LEADS)
    rows = materialized(rows, "common")
    arms = [("all", "lr", models.logistic_scores(rows, TREATED, list(names))), ("subset", "lr", models.logistic_scores(rows.where("long"), TREATED, list(names))), ("all", "rf", models.forest_scores(rows, TREATED, list(names), SMALL_FOREST))]
    scored = None
    for arm, model, part in arms:
        named = part.select(F.lit(arm).alias("arm"), F.lit(model).alias("model"), "name", "target", "fold", "y", "score")
        scored = named if scored is None else scored.unionByName(named)
    areas = _areas(materialized(scored, "scored"), names, "arm", "model", "name")
    per_fold = areas.groupBy("arm", "model", "fold", "name").agg(F.avg("auroc").alias("m"))
    return per_fold.groupBy("arm", "model", "fold").pivot("name", list(TREATED)).agg(F.first("m"))


@query("treatment_models")
def treatment_models(ev: DataFrame) -> DataFrame:
    """The folds behind the fitted verdict, and the verdict itself in each row."""
    areas = materialized(_treatment_areas(ev), "areas")
    wide = areas.groupBy("arm", "fold").pivot("model", ["lr", "rf"]).agg(F.first("base").alias("base"), F.first("treated").alias("treated"))
    verdict = evaluate.treatment_verdict(wide)
    return areas.withColumn("lift", F.col("treated") - F.col("base")).crossJoin(F.broadcast(verdict.select("verdict", "gap_grows")))  # one row


# firing: a series' score is a rule on its value, between 0 and 1

SUSTAINS, EARLIES, LATES = [0, DAY, 2 * DAY], [2 * DAY, 3 * DAY, 4 * DAY], [0, DAY // 2, DAY, 2 * DAY]
BUDGETS = [0.1, 0.2, 0.3]
TOLERANCE, BEFORE = DAY // 2, DAY
RULES = FiringRules(sustain_s=2 * DAY, tolerance_s=TOLERANCE, early_s=4 * DAY, late_s=DAY)
GRID = [k / 100 for k in range(101)]
HELD = " UNION ALL ".join(f"SELECT {s} AS sustain_s, entity, us, {'score' if s == 0 else 'min(score) OVER w'} AS high, {'true' if s == 0 else f'us - min(us) OVER w >= {(s - TOLERANCE) * 1000000}'} AS ok FROM sc" + (f" WINDOW w AS (PARTITION BY entity ORDER BY us RANGE BETWEEN {s * 1000000} PRECEDING AND CURRENT ROW)" if s else "") for s in SUSTAINS)
HIGHS = f"""{EV}, sc AS (SELECT entity, us, event_type, value / (value + 50) AS score FROM ev),
nap AS (SELECT entity, entity % 5 AS fold, min(us) AS start_us, min(us) FILTER (event_type = 'error' AND value > 20) AS onset_us, min(us) FILTER (event_type NOT IN ('view', 'signup')) AS sleep_us FROM ev GROUP BY 1),
n AS (SELECT * FROM nap WHERE onset_us IS NULL OR onset_us - start_us >= {BEFORE * 1000000}), hd AS ({HELD}), hs AS (SELECT hd.sustain_s, hd.entity, hd.us, high FROM hd JOIN n USING (entity) WHERE ok),
hm AS (SELECT *, max(high) OVER (PARTITION BY sustain_s, entity ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM hs), highs AS (SELECT sustain_s, entity, us, high FROM hm WHERE top IS NULL OR high > top)"""
FIRE = HIGHS + """, th AS (SELECT unnest(range(0, 101)) / 100 AS threshold), fires AS (SELECT sustain_s, entity, threshold, min(us) AS fire_us FROM highs JOIN th ON high >= threshold GROUP BY 1, 2, 3),
gr AS (SELECT s.sustain_s, n.entity, t.threshold, n.onset_us, f.fire_us FROM n CROSS JOIN th t CROSS JOIN (SELECT unnest([0, 86400, 172800]) AS sustain_s) s LEFT JOIN fires f ON f.entity = n.entity AND f.threshold = t.threshold AND f.sustain_s = s.sustain_s)"""
OUTCOME = "CASE WHEN onset_us IS NULL THEN CASE WHEN fire_us IS NULL THEN 'nofire' ELSE 'false_fire' END WHEN fire_us IS NULL THEN 'nofire' WHEN fire_us < onset_us - {early} THEN 'early' WHEN fire_us <= onset_us + {late} THEN 'hit' ELSE 'late' END"


def _scored(ev: DataFrame) -> DataFrame:
    return ev.select("entity", "us", "event_type", "value", (V() / (V() + 50)).alias("score"))


def _naps(ev: DataFrame) -> DataFrame:
    """(entity, fold, start_us, onset_us, sleep_us) of the entities with enough
    series before their first event."""
    first = lambda c: F.min(F.when(c, US()))
    naps = ev.groupBy("entity").agg(F.min("us").alias("start_us"), first((F.col("event_type") == "error") & (V() > 20)).alias("onset_us"), first(~F.col("event_type").isin("view", "signup")).alias("sleep_us"))
    kept = evaluate.scorable(naps.withColumn("event_us", F.col("onset_us")), BEFORE).drop("event_us")
    return kept.withColumn("fold", (F.col("entity") % 5).cast("int"))


def _held(ev: DataFrame) -> DataFrame:
    return firing.held_scores(_scored(ev), SUSTAINS, TOLERANCE).join(_naps(ev).select("entity"), "entity", "left_semi")


def _fires(ev: DataFrame) -> DataFrame:
    return firing.fire_steps(_held(ev), GRID)


@query("sustained_records", f"{HIGHS} SELECT sustain_s, entity, us, high FROM highs")
def sustained_records(ev: DataFrame) -> DataFrame:
    return firing.records(_held(ev)).select("sustain_s", "entity", "us", "high")


@query("fire_time", f"{FIRE} SELECT * FROM fires")
def fire_time(ev: DataFrame) -> DataFrame:
    return _fires(ev)


@query("classify_outcome", f"{FIRE} SELECT entity, threshold, " + OUTCOME.format(early=345_600_000_000, late=86_400_000_000) + " AS outcome FROM gr WHERE sustain_s = 172800")
def classify_outcome(ev: DataFrame) -> DataFrame:
    th = joins.parameter_grid(ev.sparkSession, threshold=GRID)
    fires = _fires(ev).where(F.col("sustain_s") == RULES.sustain_s)
    every = _naps(ev).crossJoin(F.broadcast(th)).join(fires, ["entity", "threshold"], "left")
    return every.select("entity", "threshold", firing.outcome(F.col("fire_us"), F.col("onset_us"), RULES.early_s, RULES.late_s).alias("outcome"))


@query("frontier", FIRE + """, g2 AS (SELECT gr.*, e AS early_s, l AS late_s FROM gr, (SELECT unnest([172800, 259200, 345600]) AS e), (SELECT unnest([0, 43200, 86400, 172800]) AS l))
SELECT sustain_s, early_s, late_s, threshold, round(count(*) FILTER (fire_us IS NOT NULL AND (onset_us IS NULL OR fire_us < onset_us - early_s * 1000000::BIGINT)) / count(*), 9) AS ff_rate,
round(count(*) FILTER (fire_us >= onset_us - early_s * 1000000::BIGINT AND fire_us <= onset_us + late_s * 1000000::BIGINT) / greatest(count(onset_us), 1), 9) AS hit_rate FROM g2 GROUP BY 1, 2, 3, 4""")
def frontier(ev: DataFrame) -> DataFrame:
    """The rates at 101 thresholds for each sustain, early and late limit."""
    out = firing.frontier(_fires(ev), _naps(ev), GRID, SUSTAINS, EARLIES, LATES)
    return out.select("sustain_s", "early_s", "late_s", "threshold", r("ff_rate", 9).alias("ff_rate"), r("hit_rate", 9).alias("hit_rate"))


GUARD = HIGHS + """, fv AS (SELECT sustain_s, e AS early_s, n.entity, n.fold, max(high) FILTER (onset_us IS NULL OR us < onset_us - e * 1000000::BIGINT) AS false_high FROM n JOIN highs USING (entity), (SELECT unnest([172800, 259200, 345600]) AS e) GROUP BY 1, 2, 3, 4),
gt AS (SELECT sustain_s, early_s, b AS budget, x.fold, coalesce(quantile_cont(false_high, 1 - b), 1.01) AS threshold FROM fv, (SELECT unnest(range(5)) AS fold) x, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS b) WHERE fv.fold <> x.fold GROUP BY 1, 2, 3, 4)"""
GUARD = GUARD.replace("quantile_cont(false_high, 1 - b)", "CASE b WHEN 0.1::DOUBLE THEN quantile_cont(false_high, 0.9) WHEN 0.2::DOUBLE THEN quantile_cont(false_high, 0.8) ELSE quantile_cont(false_high, 0.7) END")


def _guarded(ev: DataFrame) -> DataFrame:
    return firing.guarded_thresholds(firing.records(_held(ev)), _naps(ev), EARLIES, BUDGETS, 5)


@query("leak_guarded_threshold", f"{GUARD} SELECT sustain_s, early_s, budget, fold, round(threshold, 9) AS threshold FROM gt")
def leak_guarded_threshold(ev: DataFrame) -> DataFrame:
    return _guarded(ev).select("sustain_s", "early_s", "budget", F.col("fold").cast("long").alias("fold"), r("threshold", 9).alias("threshold"))


@query("event_surface", GUARD + """, fi AS (SELECT gt.sustain_s, gt.early_s, gt.budget, gt.fold, n.entity, n.onset_us, min(us) AS fire_us FROM n JOIN gt ON gt.fold = n.fold LEFT JOIN highs h ON h.entity = n.entity AND h.sustain_s = gt.sustain_s AND high >= threshold GROUP BY 1, 2, 3, 4, 5, 6),
oc AS (SELECT fi.*, l AS late_s FROM fi, (SELECT unnest([0, 43200, 86400, 172800]) AS l)),
fo AS (SELECT sustain_s, early_s, late_s, budget, fold, CASE WHEN count(onset_us) > 0 THEN count(*) FILTER (fire_us >= onset_us - early_s * 1000000::BIGINT AND fire_us <= onset_us + late_s * 1000000::BIGINT) / count(onset_us) END AS hit,
count(*) FILTER (fire_us IS NOT NULL AND (onset_us IS NULL OR fire_us < onset_us - early_s * 1000000::BIGINT)) / count(*) AS ff FROM oc GROUP BY 1, 2, 3, 4, 5)
SELECT sustain_s, early_s, late_s, budget, round(avg(hit), 9) AS hit_mean, round(min(hit), 9) AS hit_min, round(max(hit), 9) AS hit_max, round(avg(ff), 9) AS ff_mean FROM fo GROUP BY 1, 2, 3, 4""")
def event_surface(ev: DataFrame) -> DataFrame:
    """Hits and false fires of 108 cells, at thresholds that other folds give."""
    out = firing.event_surface(firing.records(_held(ev)), _naps(ev), _guarded(ev), LATES)
    return out.select("sustain_s", "early_s", "late_s", "budget", *[r(c, 9).alias(c) for c in ("hit_mean", "hit_min", "hit_max", "ff_mean")])


@query("event_surface_models")
def event_surface_models(ev: DataFrame) -> DataFrame:
    """The same on the scores of a model that is fitted on the other folds."""
    naps = _naps(ev)
    rows = points(ev).join(naps.select("entity", "fold"), "entity")
    rows = materialized(rows.select("entity", "us", "fold", *FEATURE_NAMES, "y"), "points")
    scored = models.logistic_scores(rows.withColumnRenamed("y", "soon"), {"all": FEATURE_NAMES}, ["soon"]).select("entity", "us", "score")
    held = materialized(firing.held_scores(scored, SUSTAINS, TOLERANCE), "held")
    found = firing.records(held)
    return firing.event_surface(found, naps, firing.guarded_thresholds(found, naps, EARLIES, BUDGETS, 5), LATES)


FLOORS, CEILINGS = [DAY, 2 * DAY, 3 * DAY, 4 * DAY], [8 * DAY, 12 * DAY, 16 * DAY]


@query("floor_ceiling", GUARD + """, g1 AS (SELECT budget, fold, threshold FROM gt WHERE sustain_s = 172800 AND early_s = 345600), cr AS (SELECT g1.budget, n.*, us FROM n JOIN g1 USING (fold) LEFT JOIN hs h ON h.entity = n.entity AND h.sustain_s = 172800 AND high >= threshold),
ga AS (SELECT budget, fold, entity, onset_us, sleep_us, f AS floor_s, c AS ceil_s, min(us) AS fire_us, min(us) FILTER (us >= sleep_us + f * 1000000::BIGINT AND us <= sleep_us + c * 1000000::BIGINT) AS gated_us
FROM cr, (SELECT unnest([86400, 172800, 259200, 345600]) AS f), (SELECT unnest([691200, 1036800, 1382400]) AS c) GROUP BY ALL),
oc AS (SELECT *, coalesce(gated_us < onset_us - 345600000000, gated_us IS NOT NULL AND onset_us IS NULL) AS gff, coalesce(gated_us BETWEEN onset_us - 345600000000 AND onset_us + 86400000000, false) AS ghit,
coalesce(fire_us < onset_us - 345600000000, fire_us IS NOT NULL AND onset_us IS NULL) AS uff, coalesce(fire_us BETWEEN onset_us - 345600000000 AND onset_us + 86400000000, false) AS uhit FROM ga),
fo AS (SELECT floor_s, ceil_s, budget, fold, count(*) FILTER (gff) / count(*) AS gff, count(*) FILTER (ghit) / count(*) AS ghit, count(*) FILTER (uff) / count(*) AS uff, count(*) FILTER (uhit) / count(*) AS uhit FROM oc GROUP BY 1, 2, 3, 4),
fm AS (SELECT floor_s, ceil_s, budget, round(avg(gff), 9) AS gated_ff_mean, round(min(gff), 9) AS gated_ff_min, round(max(gff), 9) AS gated_ff_max, round(avg(ghit), 9) AS gated_catch_mean, round(min(ghit), 9) AS gated_catch_min, round(max(ghit), 9) AS gated_catch_max, round(avg(uff), 9) AS ungated_ff_mean, round(avg(uhit), 9) AS ungated_catch_mean FROM fo GROUP BY 1, 2, 3),
po AS (SELECT floor_s, ceil_s, budget, count(*) FILTER (uff) AS orig_ff_n, count(*) FILTER (uff AND fire_us < sleep_us + floor_s * 1000000::BIGINT) AS ff_removed_floor, count(*) FILTER (uff AND fire_us > sleep_us + ceil_s * 1000000::BIGINT) AS ff_removed_ceil,
count(*) FILTER (onset_us < sleep_us + floor_s * 1000000::BIGINT) AS early_deep_fail_n, count(onset_us) AS n_onset, count(*) AS n_scorable FROM oc GROUP BY 1, 2, 3)
SELECT fm.*, orig_ff_n, ff_removed_floor, orig_ff_n - ff_removed_floor - ff_removed_ceil AS ff_remain_window, ff_removed_ceil, early_deep_fail_n, round(CASE WHEN n_onset > 0 THEN early_deep_fail_n / n_onset END, 9) AS early_deep_fail_frac, n_scorable FROM fm JOIN po USING (floor_s, ceil_s, budget)""")
def floor_ceiling(ev: DataFrame) -> DataFrame:
    """What a floor and a ceiling after falling asleep do to hits and false
    fires, where the false ones were, and which early events a floor gives up."""
    held = _held(ev).where(F.col("sustain_s") == RULES.sustain_s)
    thresholds = _guarded(ev).where((F.col("sustain_s") == RULES.sustain_s) & (F.col("early_s") == RULES.early_s)).select("budget", "fold", "threshold")
    out = firing.floor_ceiling(held, _naps(ev), thresholds, FLOORS, CEILINGS, RULES)
    return out.select(*[r(c, 9).alias(c) if c.endswith(("mean", "min", "max", "frac")) else c for c in out.columns])


# latencies and sweeps of nights: an order is a night of its customer

NIGHTS = "n AS (SELECT o_custkey, o_orderkey, o_totalprice / 10000 AS o2d, avg(o_totalprice / 10000) OVER (PARTITION BY o_custkey) AS mean, count(*) OVER (PARTITION BY o_custkey) AS nights FROM orders)"


def _nights(o: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    x = F.col("o_totalprice") / 10000
    return o.select("o_custkey", "o_orderkey", x.alias("o2d"), F.avg(x).over(w).alias("mean"), F.count("*").over(w).alias("nights")).where("nights >= 2")


HARD_SD = 10
SPREAD = f"""{NIGHTS}, sn AS (SELECT *, stddev_samp(o2d) OVER (PARTITION BY o_custkey) > {HARD_SD} AS hard FROM n WHERE nights >= 2)"""
COSTS = """count(*) FILTER (depth > {d}) AS fails, round(100.0::DOUBLE * count(*) FILTER (depth > {d}) / count(*), 6) AS fail_pct, round(avg(-depth) FILTER (depth <= 0), 6) AS sacrifice_nonfail, round(avg(greatest(-depth, 0)), 6) AS sacrifice_all,
round(CASE WHEN count(*) FILTER (depth > {d}) > 0 THEN 100.0::DOUBLE * count(*) FILTER (depth > {d} AND hard) / count(*) FILTER (depth > {d}) END, 6) AS hard_share_pct, round(100.0::DOUBLE * count(*) FILTER (hard) / count(*), 6) AS hard_nights_pct,
round(quantile_cont(depth, 0.25) FILTER (depth > {d}), 6) AS depth_q1, round(quantile_cont(depth, 0.5) FILTER (depth > {d}), 6) AS depth_median, round(quantile_cont(depth, 0.75) FILTER (depth > {d}), 6) AS depth_q3, round(max(depth) FILTER (depth > {d}), 6) AS depth_max"""
COST_COLUMNS = ("fail_pct", "sacrifice_nonfail", "sacrifice_all", "hard_share_pct", "hard_nights_pct", "depth_q1", "depth_median", "depth_q3", "depth_max")


MARGINS, TOLERANCES = [0, 2, 4, 6], [0, 1, 2, 3, 5]


def _depths(o: DataFrame) -> DataFrame:
    """Every night with how far its mean lies past its onset; written."""
    sd = F.stddev_samp("o2d").over(Window.partitionBy("o_custkey"))
    nights = _nights(o).select((sd > HARD_SD).alias("hard"), (F.col("mean") - F.col("o2d")).alias("past"))
    return materialized(nights, "nights")


@query("firing_sweep", f"{SPREAD}, x AS (SELECT *, mean - m - o2d AS depth FROM sn, (SELECT unnest([0, 2, 4, 6]) AS m)) SELECT m, count(*) AS nights, {COSTS.format(d=0)} FROM x GROUP BY 1", of=table("orders"))
def firing_sweep(o: DataFrame) -> DataFrame:
    """What firing so long before an own mean costs, and who pays."""
    out = firing.depth_costs(_depths(o), MARGINS, [0])
    return out.select("m", "nights", "fails", *[r(c).alias(c) for c in COST_COLUMNS])


@query("depth_grid", f"""{SPREAD}, x AS (SELECT *, mean - m - o2d AS depth FROM sn, (SELECT unnest([0, 2, 4, 6]) AS m), (SELECT unnest([0, 1, 2, 3, 5]) AS d))
SELECT m, d, count(*) AS nights, {COSTS.format(d="d")}, count(*) FILTER (depth <= 0) AS before, count(*) FILTER (depth > 0 AND depth <= d) AS in_band FROM x GROUP BY 1, 2""", of=table("orders"))
def depth_grid(o: DataFrame) -> DataFrame:
    """The same by tolerated depth, with how many land within the tolerance."""
    out = firing.depth_costs(_depths(o), MARGINS, TOLERANCES)
    return out.select("m", "d", "nights", "fails", *[r(c).alias(c) for c in COST_COLUMNS], "before", "in_band")


@query("depth_costs", of=table("orders"))
def depth_costs(o: DataFrame) -> DataFrame:
    """The costs of every margin and tolerance, unrounded."""
    return firing.depth_costs(_depths(o), MARGINS, TOLERANCES)


LATENCY = f"""{EV}, o AS (SELECT *, event_type <> 'view' AS o FROM ev), g AS (SELECT *, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY us) AS g FROM o),
rn AS (SELECT entity, min(us) AS s FROM g WHERE o GROUP BY entity, g HAVING count(*) >= 3), f AS (SELECT entity, min(s) AS onset_us FROM rn GROUP BY 1),
dp AS (SELECT f.entity, onset_us, min(us) FILTER (event_type = 'error' AND us >= onset_us) AS deep_us FROM f JOIN ev USING (entity) GROUP BY 1, 2)"""


def _latency(ev: DataFrame) -> DataFrame:
    onset = series.runs(ev, F.col("event_type") != "view").where("n >= 3").groupBy("entity").agg(F.min("start_us").alias("onset_us"))
    deep = F.min(F.when((F.col("event_type") == "error") & (US() >= F.col("onset_us")), US()))
    return ev.join(onset, "entity").groupBy("entity", "onset_us").agg(deep.alias("deep_us"))


@query("onset_to_deep", f"{LATENCY} SELECT entity, round((deep_us - onset_us)::DOUBLE / 6e7, 9) AS minutes FROM dp")
def onset_to_deep(ev: DataFrame) -> DataFrame:
    return _latency(ev).select("entity", r((F.col("deep_us") - F.col("onset_us")).cast("double") / 6e7, 9).alias("minutes"))


@query("onset_latency", f"{LATENCY}, s AS (SELECT entity, min(us) AS us FROM ev GROUP BY 1) SELECT entity, round((onset_us - us)::DOUBLE / 6e7, 9) AS minutes FROM dp JOIN s USING (entity)")
def onset_latency(ev: DataFrame) -> DataFrame:
    first = ev.groupBy("entity").agg(F.min("us").alias("us"))
    return _latency(ev).join(first, "entity").select("entity", r((F.col("onset_us") - F.col("us")).cast("double") / 6e7, 9).alias("minutes"))


@query("detect_onset", f"""{EV}, x AS (SELECT entity, us, CASE WHEN event_type <> 'click' THEN value END AS v, CASE WHEN event_type = 'click' THEN value END AS mo FROM ev),
w AS (SELECT *, CASE WHEN v IS NOT NULL THEN quantile_cont(v, 0.5) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 129600000000 PRECEDING AND 129600000000 FOLLOWING) END AS med, quantile_cont(v, 0.5) OVER (PARTITION BY entity) AS base, quantile_cont(mo, 0.25) OVER (PARTITION BY entity) AS q25, min(us) OVER (PARTITION BY entity) AS u0 FROM x),
m AS (SELECT *, max(med) OVER f AS hi, quantile_cont(mo, 0.5) OVER f AS still FROM w WINDOW f AS (PARTITION BY entity ORDER BY us RANGE BETWEEN CURRENT ROW AND 172800000000 FOLLOWING))
SELECT entity, min(us) AS onset_us FROM m WHERE us - u0 >= 86400000000 AND med <= base - 2 AND hi <= base - 2 AND still <= q25 GROUP BY 1""")
def detect_onset(ev: DataFrame) -> DataFrame:
    """The first time from which on the smoothed value stays below the baseline
    while motion stays in its lowest quarter; two days long. Clicks are motion."""
    q, whole = (lambda x, p: F.percentile(x, F.lit(p))), Window.partitionBy("entity")
    ahead = series.along().rangeBetween(0, 2 * DAY * series.S)
    motion = F.col("event_type") == "click"
    rows = ev.select("entity", "us", F.when(~motion, V()).alias("v"), F.when(motion, V()).alias("mo"))
    known = rows.select("*", F.when(F.col("v").isNotNull(), q(F.col("v"), 0.5).over(series.centred(3 * DAY))).alias("med"), q(F.col("v"), 0.5).over(whole).alias("base"), q(F.col("mo"), 0.25).over(whole).alias("q25"), F.min("us").over(whole).alias("u0"))
    held = known.select("*", F.max("med").over(ahead).alias("hi"), q(F.col("mo"), 0.5).over(ahead).alias("still"))
    low = F.col("base") - 2
    return held.where((US() - F.col("u0") >= DAY * series.S) & (F.col("med") <= low) & (F.col("hi") <= low) & (F.col("still") <= F.col("q25"))).groupBy("entity").agg(F.min("us").alias("onset_us"))


@query("shape_by_stage", f"""{EV}, s AS (SELECT event_type, stddev_samp(value) OVER (PARTITION BY entity ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) AS sd FROM ev)
SELECT event_type, count(sd) AS n, round(quantile_cont(sd, 0.5), 6) AS median_sd FROM s GROUP BY 1""")
def shape_by_stage(ev: DataFrame) -> DataFrame:
    rows = ev.select("event_type", series.trailing_sd(V(), series.trailing(3 * DAY)).alias("sd"))
    counts = rows.groupBy("event_type").agg(F.count("sd").alias("n"))
    return counts.join(stats.ranked_quantiles(rows, "sd", {"median_sd": 0.5}, ["event_type"]), "event_type", "left").select("event_type", "n", r("median_sd").alias("median_sd"))


@query("quiet_report", f"""{EV}, x AS (SELECT entity, count(*) FILTER (value < 20) AS quiet, max(value) AS ceiling, count(*) AS n FROM ev GROUP BY 1) SELECT entity, quiet, ceiling, n FROM x WHERE n >= 50""")
def quiet_report(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(F.count(F.when(V() < 20, 1)).alias("quiet"), F.max("value").alias("ceiling"), F.count("*").alias("n")).where("n >= 50")
