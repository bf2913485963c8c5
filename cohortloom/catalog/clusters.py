"""Clustering and sampling.

Clusters depend on the engine's random numbers, so their numbers have no SQL equivalent; the sample, the scaling,
the inertia of one cluster and the nearness of every row to its centre do.
"""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortloom.catalog.clients import ANY_FLAGS, CITIES, MEANS, SUM_FLAGS, _STAGES, mart
from cohortloom.catalog.registry import query, tidy, tidy_mean
from cohortloom.catalog.sql import TYPES, cut, with_parts
from cohortloom.operators import clustering, reports
from cohortloom.operators.sampling import sample_by_key, sample_sql
from cohortloom.plans.client_mart import CHANGE_MONTHS, CHANGES, cover_name
from cohortloom.session import new_folder
from cohortloom.sources.sinks import stage, write_partitions
from cohortloom.sources.tables import parquet_table

# Numbers are imputed by their mean and standardised; flags, counts of flags and deciles stay as they are.
SCALED = [
    "client_tenure", "pol_count", "ins_typ_count", "inforce_pol", "lapsed_pol", "surrendered_pol", "matured_pol", "nottaken_pol", "terminated_pol",
    "oth_paid_pol", "coverage_ape", "plan_nbv", "cli_nbv_margin", "cli_ltv", "cli_ltv_pre", "cli_ltv_post", "total_ape", "cur_age", "frst_iss_age", "no_dpnd", "mthly_incm",
    "agt_tenure_yrs", "cws_tenure_days", "cws_last_log_days", "app_tenure_days", "app_last_log_days",
]
_PLACES = [f"f_{n}_{kind.lower()}" for n in ("1st", "2nd") for kind in TYPES]
PLAIN = [
    "multi_prod", "annual_flag", "valid_email", "valid_mobile", "inforce_ind", "f_male", "10yr_pol_cnt", "min_decile", "early_decile", "next_due_decile", "yr_2nd_prod",
    *TYPES.values(), *ANY_FLAGS, *SUM_FLAGS, *CITIES, "f_oth_city", *_STAGES, *map(cover_name, TYPES), *(f"f_{k}chg_{n}m" for k in CHANGES for n in CHANGE_MONTHS), "f_vip_elite", "f_vip_plat", "f_vip_gold", "f_vip_silver", *_PLACES,
]
SENTINELS = {c: 99.0 for c in ("min_decile", "early_decile", "next_due_decile", "yr_2nd_prod")}
WEIGHTS = {"cli_ltv": 10.0}
FRACTION, SEED, K = 0.3, 123, 5


def _numbers(wide, sampled=True):
    """Features as numbers, stored; deciles and flags are filled, and so is what no client of the fit, a sample or all, has."""
    told = clustering.as_numbers(wide.select("po_num", *[f"`{c}`" for c in (*SCALED, *PLAIN)]), [*SCALED, *PLAIN])
    features = stage(told.fillna(SENTINELS).fillna(0, subset=PLAIN), new_folder(wide.sparkSession))
    fitted = sample_by_key(features, "po_num", FRACTION, SEED) if sampled else features
    unknown = clustering.without_values(fitted, SCALED)
    return features.fillna(0, subset=unknown) if unknown else features


def _features(t, sampled=True):
    return _numbers(mart(t, channel=None), sampled)


def _pipeline():
    return clustering.feature_pipeline(SCALED, PLAIN, WEIGHTS)


def _fitted(t, features):
    """The model of a sample, stored and loaded again."""
    path = new_folder(t.spark)
    clustering.save_model(clustering.fit_clusters(sample_by_key(features, "po_num", FRACTION, SEED), _pipeline(), K, SEED), path)
    return clustering.load_model(path)


def _clustered(t):
    """Fit on a sample, store the model, and score every client with the stored one."""
    features = _features(t)
    return clustering.assign_clusters(features, _fitted(t, features))


@query("kmeans_clusters")
def kmeans_clusters(t):
    return _clustered(t).select("po_num", "clusters")


def _mart_with_clusters(t):
    """The client mart next to the cluster of each client, from scores stored by cluster."""
    wide = stage(mart(t, channel=None), new_folder(t.spark))
    features = _numbers(wide)
    path = new_folder(t.spark)
    scored = clustering.assign_clusters(features, _fitted(t, features)).select("po_num", "clusters")
    write_partitions(scored.hint("rebalance", "clusters"), path, ("clusters",))
    return wide.join(parquet_table(t.spark, path), "po_num", "left")


@query("clustered_mart", with_parts("""
select po_num, round(cli_ltv, 2) as cli_ltv, channel_final, cast(pol_count as bigint) as pol_count, true as has_cluster from client_mart_all""", "client_mart_all"))
def clustered_mart(t):
    """Every client has one of the clusters; which one depends on the engine."""
    has = F.col("clusters").between(0, K - 1)
    return tidy(_mart_with_clusters(t).select("po_num", F.round("cli_ltv", 2).alias("cli_ltv"), "channel_final", "pol_count", has.alias("has_cluster")))


@query("cluster_profile")
def cluster_profile(t):
    return tidy(reports.profile(_mart_with_clusters(t), ["clusters"], "po_num", MEANS, "customer_count"), 2)


@query("cluster_totals", with_parts("""
select count(*) as clients, cast(sum(pol_count) as bigint) as pol_count, """ + cut("sum(cast(cli_ltv as decimal(28, 8)))", 2) + """ as cli_ltv, cast(0 as bigint) as misplaced
from client_mart_all""", "client_mart_all"))
def cluster_totals(t):
    """The profile adds up to the base, and no client is nearer to another stored centre than to its own."""
    features = _features(t)
    model = _fitted(t, features)
    scored = model.transform(features)
    per_cluster = scored.withColumn("_wrong", clustering.misplaced(scored, clustering.centres(model))).groupBy("clusters").agg(
        F.count(F.lit(1)).alias("clients"), F.sum("pol_count").alias("pol_count"), F.sum(F.col("cli_ltv").cast("decimal(28,8)")).alias("cli_ltv"),
        F.sum(F.col("_wrong").cast("long")).alias("misplaced"),
    )
    return tidy(per_cluster.agg(
        F.sum("clients").alias("clients"), F.sum("pol_count").cast("long").alias("pol_count"), F.sum("cli_ltv").cast("double").alias("cli_ltv"), F.sum("misplaced").alias("misplaced")
    ), 2)


_SAMPLE = f"s as (select * from client_mart_all where {sample_sql('po_num', FRACTION, SEED)})"


def _imputed(c):
    return f'coalesce(cast("{c}" as double), avg("{c}") over (), 0)'


@query("feature_scaling", with_parts(
    f"select * from (with {_SAMPLE} " + " union all ".join(
        f"select '{c}' as feature, {cut('avg(x)', 3)} as mean, {cut('coalesce(stddev_samp(x), 0)', 3)} as sd from (select {_imputed(c)} as x from s)" for c in SCALED
    ) + ")", "client_mart_all"))
def feature_scaling(t):
    """Mean and deviation by which each number of the sampled clients is standardised."""
    model = _pipeline().fit(sample_by_key(_features(t), "po_num", FRACTION, SEED))
    return tidy_mean(clustering.scaling(model, SCALED, t.spark), 3)


def _spread_sql(c):
    if c in SCALED:
        weight = WEIGHTS.get(c, 1.0) ** 2
        return f"select '{c}' as feature, {cut(f'case when stddev_samp(x) > 0 then (count(*) - 1) * {weight} else 0 end', 3)} as inertia from (select {_imputed(c)} as x from s)"
    return f"""select '{c}', {cut('coalesce(var_pop(x) * count(*), 0)', 3)} from (select coalesce(cast("{c}" as double), {SENTINELS.get(c, 0.0)}) as x from s)"""


@query("one_cluster_inertia", with_parts(f"select * from (with {_SAMPLE} " + " union all ".join(_spread_sql(c) for c in (*SCALED, *PLAIN)) + ")", "client_mart_all"))
def one_cluster_inertia(t):
    """The inertia of one cluster of the sampled clients, feature by feature."""
    sampled = sample_by_key(_features(t), "po_num", FRACTION, SEED)
    return tidy_mean(clustering.inertia_by_feature(_pipeline().fit(sampled).transform(sampled).select(clustering.FEATURES), [*SCALED, *PLAIN]), 3)


@query("elbow_table")
def elbow_table(t):
    """Inertia for one to nine clusters of all clients."""
    return clustering.elbow_table(_features(t, sampled=False), _pipeline(), 9, SEED)


@query("seeded_sample", f"select c_custkey as cli_num from customer where {sample_sql('c_custkey', FRACTION, SEED)}")
def seeded_sample(t):
    return sample_by_key(t.clients().select("cli_num"), "cli_num", FRACTION, SEED)


@query("embedding_clusters")
def embedding_clusters(t):
    """Clusters of the given vectors."""
    known = t.raw("embeddings").where(F.col("embedding").isNotNull())
    vectors = known.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    model = clustering.fit_clusters(vectors, clustering.vector_pipeline("vector"), 5, SEED)
    return clustering.assign_clusters(vectors, model).groupBy("clusters").agg(F.count(F.lit(1)).alias("vectors"))
