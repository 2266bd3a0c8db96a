"""Prototype retrieval by cosine similarity, and per-key anomaly models."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shipping import ship
from ..storage import stored

#: Tasks that the rows of one model are dealt to.
SALTS = 16
#: Vectors of queries and of items that one task multiplies at once.
QUERY_BLOCK, ITEM_BLOCK = 512, 4_096


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The vector divided by its length; a zero vector stays."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = F.array(F.when(squares == 0, 1.0).otherwise(F.sqrt(squares)))
    # a lambda over the one length, so that it is computed once a row and not once an element
    return df.withColumn(vector, F.transform(length, lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0])


def _blocks(df: DataFrame, key: str, identity: str, vector: str, size: int) -> DataFrame:
    """(key, block, ids, vectors): the rows of each key in blocks of about ``size`` by hash; null vectors and keys are left out."""
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(identity).alias("_id"), F.col(vector).alias("_v"))
    counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
    dealt = rows.join(counts, key).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    held = F.collect_list(F.struct("_id", "_v")).alias("x")  # about ``size`` rows
    return dealt.groupBy(key, "_block", "_blocks").agg(held).select(key, "_block", "_blocks", F.col("x._id").alias("_ids"), F.col("x._v").alias("_vectors"))


def _best_of_blocks(queries: DataFrame, bank: DataFrame, query: str, item: str, key: str, vector: str, k: int, others_only: bool) -> DataFrame:
    """(query, _item, sim): of every pair of a block of queries and a block of items of one key the k best items of each query, by a matrix product."""
    asked = _blocks(unit_vectors(queries, vector), key, query, vector, QUERY_BLOCK).select(key, F.col("_ids").alias("_qids"), F.col("_vectors").alias("_queries"))
    items = _blocks(unit_vectors(bank, vector), key, item, vector, ITEM_BLOCK)
    most = items.groupBy(key).agg(F.max("_blocks").alias("_blocks"))
    pairs = asked.join(most, key).select(key, "_qids", "_queries", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")).join(items.drop("_blocks"), [key, "_block"])
    kind, item_kind = dict(queries.dtypes)[query], dict(bank.dtypes)[item]

    def run(batches):
        for batch in batches:
            for qids, vectors, ids, own in zip(*(batch.column(c) for c in ("_qids", "_queries", "_ids", "_vectors"))):
                qids, ids = qids.as_py(), ids.as_py()
                sims = _matrix(vectors, len(qids)) @ _matrix(own, len(ids)).T
                if others_only:
                    place = {x: j for j, x in enumerate(ids)}
                    for i, x in enumerate(qids):
                        if x in place:
                            sims[i, place[x]] = -np.inf
                order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(sims, order, axis=1)
                rows, _ = np.nonzero(np.isfinite(best))
                arrays = [pa.array([qids[i] for i in rows], batch.schema.field("_qids").type.value_type), pa.array([ids[j] for j in order[np.isfinite(best)]], batch.schema.field("_ids").type.value_type)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(best[np.isfinite(best)])], [query, "_item", "sim"])

    ship(queries.sparkSession)
    return pairs.select("_qids", "_queries", "_ids", "_vectors").mapInArrow(run, f"{query} {kind}, _item {item_kind}, sim double").withColumn("sim", F.round("sim", 6))


def top_similarities(queries: DataFrame, bank: DataFrame, query: str, item: str, key: str, vector: str, k: int, others_only: bool = False) -> DataFrame:
    """SO-02, JN-26: for each query the greatest cosine among bank items of its key and the mean of the k greatest.

    Blocks of queries meet blocks of items of their key as matrix products, a task a pair of blocks, whose k best of each query are merged;
    a large key is many blocks. ``others_only`` leaves out the item whose id is the query's. Keys without items give no row.
    """
    found = _best_of_blocks(queries, bank, query, item, key, vector, k, others_only)
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("sim")))).where(F.col("_r") <= k)
    return ranked.groupBy(query).agg(F.max("sim").alias("top1"), F.round(F.avg("sim"), 6).alias("topk_mean"))


def _with_buckets(df: DataFrame, vector: str, bits: int, tables: int, seed: int, keys: list[str]) -> DataFrame:
    """A row per table: the bucket is the table, the sides of its ``bits`` random hyperplanes on which the vector lies, and the values of the keys. Null and zero vectors have none."""

    def run(batches):
        for batch in batches:
            codes = []
            for v in batch.column(0).to_pylist():
                x = np.asarray(v, np.float64)
                planes = np.random.default_rng([seed, len(x)]).normal(size=(tables, bits, len(x))) if not codes or len(x) != planes.shape[2] else planes
                codes.append(((planes @ x >= 0) << np.arange(bits)).sum(axis=1).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], [*batch.schema.names, "_codes"])

    rows = df.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(vector).alias("_v"), *df.columns)
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "_codes array<long>"])
    coded = rows.mapInArrow(run, fields).drop("_v")
    bucket = F.concat_ws(":", "_table", "_code", *[F.col(c).cast("string") for c in keys])
    return coded.select("*", F.posexplode("_codes").alias("_table", "_code")).withColumn("_bucket", bucket).drop("_codes", "_table", "_code")


def indexed_neighbours(
    queries: DataFrame, bank: DataFrame, query: str, item: str, vector: str, k: int, bits: int, tables: int, keys: list[str] | None = None, seed: int = 42, others_only: bool = False
) -> DataFrame:
    """SO-02, JN-26 by an index: (query, item, sim, rank) of the k bank items of the greatest cosine among those that share a bucket with the query.

    Every bank row stands in one bucket of each table; a query meets the items of its own buckets only, block by block, and they are ranked by their exact
    cosine. Items at an angle a are met with probability 1 - (1 - (1 - a / pi) ** bits) ** tables: measure it with ``recall_of`` and take more tables, or the exact
    top_similarities, where it is too low. Of equal cosines the lesser item comes first. Queries without a shared bucket have no row.
    """
    ship(queries.sparkSession)
    asked, held = (_with_buckets(df, vector, bits, tables, seed, keys or []) for df in (queries, bank))
    met = _best_of_blocks(asked, held, query, item, "_bucket", vector, k + int(others_only), others_only)
    once = met.groupBy(query, F.col("_item").alias(item)).agg(F.max("sim").alias("sim"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("sim"), item))).where(F.col("rank") <= k)


def recall_of(found: DataFrame, queries: DataFrame, bank: DataFrame, query: str, item: str, vector: str, k: int, others_only: bool = False, sample: int = 200) -> float:
    """The share of the exact k nearest items that ``found`` has, over the ``sample`` queries of least hash; 1 without queries."""
    some = queries.orderBy(F.xxhash64(query), query).limit(sample).withColumn("_all", F.lit(1))
    exact = _best_of_blocks(some, bank.withColumn("_all", F.lit(1)), query, item, "_all", vector, k + int(others_only), others_only)
    ranked = exact.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("sim"), "_item"))).where(F.col("_r") <= k)
    both = ranked.join(found.select(query, F.col(item).alias("_item"), F.lit(1).alias("_hit")), [query, "_item"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0)).alias("x")).first()["x"]  # one row


def _matrix(rows, n: int) -> np.ndarray:
    return rows.values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def retrieval_verifier(queries: DataFrame, bank: DataFrame, confusable: DataFrame, query: str, item: str, key: str, vector: str, k: int = 5, low: float = 0.15, least_margin: float = 0.03, group: str | None = None, others_only: bool = False) -> DataFrame:
    """ML-02, ML-03: similarity to the own key against that to its confusable keys (a table key, other), and a decision.

    ``queries`` carries is_error, the main model's decision. A key without items is compared with the items of its
    ``group`` (a column of both tables); without these either, it has similarity 0.
    """
    same = top_similarities(queries, bank, query, item, key, vector, k, others_only)
    if group:
        bare = queries.join(bank.select(key).distinct(), key, "left_anti").where(F.col(group) != "")
        same = same.unionByName(top_similarities(bare, bank, query, item, group, vector, k, others_only))
    others = confusable.select(F.col(key).alias("_key"), F.col("other").alias(key))
    asked = queries.withColumnRenamed(key, "_key").join(others, "_key").select(query, key, vector)
    crossed = top_similarities(asked, bank, query, item, key, vector, k, others_only).groupBy(query).agg(F.max("top1").alias("_other"))
    rows = queries.join(same, query, "left").join(crossed, query, "left")
    s, o = F.coalesce("top1", F.lit(0.0)), F.coalesce("_other", F.lit(0.0))
    error = F.col("is_error") == 1
    decision = (
        F.when(error & (o > s), "likely_error").when(error & (s >= low) & (s - o >= least_margin), "likely_correct").when(error, "uncertain_review")
        .when(s < low, "candidate_error_for_review").otherwise("likely_correct")
    )
    return rows.select(
        query, key, s.alias("proto_same_sim_top1"), F.coalesce("topk_mean", F.lit(0.0)).alias("proto_same_sim_topk_mean"), o.alias("proto_confusion_sim_top1"),
        F.round(s - o, 6).alias("proto_margin"), decision.alias("retrieval_verifier_decision"),
    )


class IsolationForest:
    """Isolation trees over random subsamples; the score is higher the fewer cuts isolate a row."""

    def __init__(self, trees: int = 50, sample: int = 128, seed: int = 42, contamination: float = 0.08):
        self.trees, self.sample, self.seed, self.contamination = trees, sample, seed, contamination
        self.forest: list = []

    def fit(self, x: np.ndarray) -> IsolationForest:
        random = np.random.default_rng(self.seed)
        self.size = min(self.sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.forest = [self._grow(x[random.choice(len(x), self.size, replace=False)], depth, random) for _ in range(self.trees)]
        #: What separates the share of training rows that count as contamination from the others.
        self.offset = float(np.percentile(-self.anomaly(x), 100 * self.contamination)) if len(x) else -0.5
        return self

    def _grow(self, x, depth, random):
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth == 0 or len(x) <= 1 or not len(usable):
            return len(x)
        f = int(random.choice(usable))
        cut = float(random.uniform(x[:, f].min(), x[:, f].max()))
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], depth - 1, random), self._grow(x[~left], depth - 1, random)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), 0..1."""
        depth = np.zeros(len(x))
        for tree in self.forest:
            stack = [(tree, np.arange(len(x)), 0)]
            while stack:
                node, rows, at = stack.pop()
                if not isinstance(node, tuple):
                    depth[rows] += at + _expected(node)
                    continue
                f, cut, low, high = node
                left = x[rows, f] < cut
                stack += [(low, rows[left], at + 1), (high, rows[~left], at + 1)]
        return 2.0 ** (-depth / max(len(self.forest), 1) / max(_expected(self.size), 1e-9))


    def oneclass(self, x: np.ndarray) -> np.ndarray:
        """1 / (1 + exp(4 d)) of d, the normality (-anomaly) above the offset: over 0.5 beyond the contamination's quantile."""
        return 1.0 / (1.0 + np.exp(4.0 * (-self.anomaly(x) - self.offset)))


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def anomaly_verifier(train: DataFrame, rows: DataFrame, key: str, group: str, features: list[str], least_key: int = 20, least_group: int = 50, fit_rows: int = 2000, sample: int = 512, contamination: float = 0.08) -> DataFrame:
    """ML-05, ML-06: anomaly of each row by the model of its key, else of its group, else of all; adds anomaly_score, oneclass_anomaly_score and anomaly_model.

    A model is fitted on about ``fit_rows`` rows of its key, those whose hash lies below fit_rows / n (isolation
    trees see small subsamples anyway). A model comes before its rows in a task, so it is read once there; the rows of a
    model are dealt to SALTS tasks. Rows are scored in batches. anomaly_score is 2 ** (-path); oneclass_anomaly_score is 1 / (1 + exp(4 d)), d the
    normality above the ``contamination`` quantile of the rows that the model was fitted on, which goes with the forest. A tree sees up to ``sample`` rows.
    """
    levels = [("k:", key, least_key), ("g:", group, least_group), ("all", None, 1)]

    def names(df: DataFrame) -> list:
        return [F.concat(F.lit(mark), F.col(c).cast("string")) if c else F.lit(mark) for mark, c, _ in levels]

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        x = batch[features].astype(float).fillna(0.0).to_numpy()
        return pd.DataFrame({"anomaly_model": [batch["model"].iloc[0]], "_forest": [pickle.dumps(IsolationForest(sample=sample, contamination=contamination).fit(x))]})

    ship(train.sparkSession)
    each = F.array(*[F.struct(F.lit(i).alias("level"), name.alias("model")) for i, name in enumerate(names(train))])
    named = stored(train.select(*features, F.xxhash64(*train.columns).alias("_hash"), F.inline(each)).where("model IS NOT NULL"), "named")
    least = F.array(*[F.lit(n) for _, _, n in levels])
    enough = named.groupBy("level", "model").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least[F.col("level")]).select("model", "_n")
    enough = stored(enough, "models")
    share = F.pmod(F.col("_hash"), F.lit(1 << 30)) / float(1 << 30)
    models = named.join(enough, "model").where(share * F.col("_n") < fit_rows).groupBy("model").applyInPandas(fit, "anomaly_model string, _forest binary")
    own = rows
    for i, name in enumerate(names(rows)):
        own = own.withColumn(f"_m{i}", name).join(enough.select(F.col("model").alias(f"_m{i}"), F.lit(True).alias(f"_h{i}")), f"_m{i}", "left")
    chosen = F.coalesce(*[F.when(F.col(f"_h{i}"), F.col(f"_m{i}")) for i in range(len(levels))])
    own = own.select(*rows.columns, chosen.alias("anomaly_model"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int").alias("_salt"), F.lit(1).alias("_order"))
    dealt = models.withColumns({"_order": F.lit(0), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))})
    together = own.unionByName(dealt, allowMissingColumns=True).repartition("anomaly_model", "_salt").sortWithinPartitions("anomaly_model", "_salt", "_order")
    columns = [*rows.columns, "anomaly_model"]

    def score(batches):
        name = forest = None
        for batch in batches:
            models, stored = batch.column("anomaly_model").to_pylist(), batch.column("_forest")
            x = np.column_stack([np.nan_to_num(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False)) for f in features])
            scores, oneclass, fresh = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan), batch.column("_order").to_numpy() == 0
            cuts = [0, *[i for i in range(1, batch.num_rows) if models[i] != models[i - 1] or fresh[i] != fresh[i - 1]], batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if fresh[a]:
                    name, forest = models[a], pickle.loads(stored[a].as_py())
                elif models[a] is not None and models[a] == name:
                    scores[a:b], oneclass[a:b] = forest.anomaly(x[a:b]), forest.oneclass(x[a:b])
            kept, out = pa.array(~fresh), [pa.array(s, mask=np.isnan(s)) for s in (scores, oneclass)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *out], [*columns, "anomaly_score", "oneclass_anomaly_score"]).filter(kept)

    kinds = dict(own.dtypes)
    scored = together.mapInArrow(score, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "anomaly_score double", "oneclass_anomaly_score double"]))
    return scored.withColumns({c: F.round(c, 6) for c in ("anomaly_score", "oneclass_anomaly_score")})


def oneclass_decision(main_error: Column, score: Column) -> Column:
    """ML-06: the one-class verifier's decision of a row by the main model's decision and its one-class score; without a score, that of 0."""
    value, error = F.coalesce(score, F.lit(0.0)), F.coalesce(main_error, F.lit(False))
    return (
        F.when(error & (value >= 0.55), "high_confidence_error").when(error, "uncertain_review")
        .when(value >= 0.70, "candidate_error_for_review").otherwise("likely_correct")
    )
