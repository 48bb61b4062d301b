"""Embedding jobs, clusters per app, representatives, summaries, scoring units."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from critiq.functions.text import long_enough, unit_id
from critiq.sources.scratch import saved

BATCH = 128
#: Rows whose distances are held at a time; bytes of centres that go to the tasks at a time.
BLOCK_ROWS, CENTRE_BYTES = 1_000, 64 << 20
#: Draws after the first start, and rounds at most.
PASSES, ROUNDS = 3, 20


def hashed_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: signed counts of hashed words, split at `[\\x20\\x09-\\x0D]+`.

    A word's dimension is the first eight hex digits of its md5 modulo `dims`, its sign the ninth's parity (odd: minus). Every
    different word of a batch is hashed once, all counts are added in one step.
    """
    def encode(texts: list[str]) -> np.ndarray:
        split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w] for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        words = pd.factorize(np.array([w for s in split for w in s], object))
        codes = [hashlib.md5(w.encode()).hexdigest() for w in words[1]]
        dim = np.array([int(c[:8], 16) % dims for c in codes], np.int64)
        sign = np.array([1 - 2 * (int(c[8], 16) & 1) for c in codes], np.int64)
        out = np.zeros((len(texts), dims), np.int64)
        if len(row):
            np.add.at(out, (row, dim[words[0]]), sign[words[0]])
        return out

    return encode


def embed(rows: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_encoder, text: str = "text") -> DataFrame:
    """rows with `emb`, unit vectors of the text in batches of BATCH; a batch that fails gives zero vectors, no row is lost."""
    def run(batches):
        encode, width = make_encoder(), 1
        for batch in batches:
            vectors: list = []
            for at in range(0, len(batch), BATCH):
                texts = [t or "" for t in batch[text].iloc[at : at + BATCH]]
                try:
                    x = np.asarray(encode(texts), float)
                    width = x.shape[1]
                except Exception:  # noqa: BLE001  the encoder is the caller's: its batch becomes zeros
                    x = np.zeros((len(texts), width))
                vectors += list((x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32))
            yield batch.assign(emb=vectors)

    return rows.mapInPandas(run, rows.withColumn("emb", F.array().cast("array<float>")).schema)


def cluster_count(rows: DataFrame, low: int = 8, high: int = 24) -> DataFrame:
    """(appid, n, k): the root of n rounded half to even, within low and high, at most n and at least 1."""
    counts = rows.groupBy("appid").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.greatest(F.lit(1), F.least(F.col("n"), F.greatest(F.lit(low), F.least(F.lit(high), F.rint(F.sqrt("n")))))).cast("int"))


def _by_app(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(app, its places in the batch, its vectors)."""
    apps = batch.column("appid").dictionary_encode()
    codes, emb = apps.indices.to_numpy(), batch.column("emb")
    if not len(codes):
        return
    x = emb.flatten().to_numpy().astype(float).reshape(len(codes), -1)
    order = np.argsort(codes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield apps.dictionary[codes[places[0]]].as_py(), places, x[places]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, to nine places so that equal ones are equal however they were summed."""
    return np.round(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0), 9)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the smaller number; BLOCK_ROWS rows at a time."""
    return np.concatenate([_distances(x[i : i + BLOCK_ROWS], centres).argmin(1) for i in range(0, len(x), BLOCK_ROWS)])


def _drawn(rows: DataFrame, centres: dict[str, np.ndarray], turn: int, most: int) -> dict[str, list]:
    """The `most` rows of each app that come first by -ln(u) / distance**2 to the nearest of its centres, u being a hash of id and
    turn: draws without replacement, weighted by the squared distance. The first turn has no centres and goes by u alone."""
    u = (F.conv(F.substring(F.md5(F.concat("reviewId", F.lit(f":{turn}")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    def keyed(batches):
        for batch in batches:
            keep, keys = [], []
            for app, places, x in _by_app(batch):
                key = batch.column("u").to_numpy()[places]
                if centres:
                    if app not in centres:
                        continue
                    far = np.concatenate([_distances(x[i : i + BLOCK_ROWS], centres[app]).min(1) for i in range(0, len(x), BLOCK_ROWS)])
                    places, key, far = places[far > 0], key[far > 0], far[far > 0]
                    key = -np.log(key) / far
                first = np.argsort(key, kind="stable")
                first = first[key[first] <= key[first[min(most, len(first)) - 1]]] if len(first) else first  # equal keys stay, for the tie by id
                keep.append(places[first])
                keys.append(key[first])
            if keep:
                at = pa.array(np.concatenate(keep))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("appid", "reviewId", "emb")], pa.array(np.concatenate(keys))], ["appid", "reviewId", "emb", "key"])

    found = rows.select("appid", "reviewId", F.col("emb").cast("array<double>").alias("emb"), u.alias("u")).mapInArrow(keyed, "appid string, reviewId string, emb array<double>, key double")
    place = F.row_number().over(W.partitionBy("appid").orderBy("key", "reviewId", "emb"))
    drawn: dict[str, list] = {}
    for r in found.withColumn("place", place).filter(F.col("place") <= most).orderBy("appid", "place").collect():  # `most` rows an app
        drawn.setdefault(r.appid, []).append(r.emb)
    return drawn


def _started(rows: DataFrame, k: dict[str, int]) -> dict[str, np.ndarray]:
    """Up to k starts of every app: one, then PASSES draws of equal size over all apps at once. Fewer where there are fewer different vectors."""
    centres = {app: np.array(x) for app, x in _drawn(rows, {}, 0, 1).items()}
    size = {app: -(-(k[app] - 1) // PASSES) for app in centres}
    for turn in range(1, PASSES + 1):
        open_apps = {app: c for app, c in centres.items() if len(c) < k[app]}
        if not open_apps:
            break
        for app, x in _drawn(rows, open_apps, turn, max(size[a] for a in open_apps)).items():
            centres[app] = np.vstack((centres[app], x[: min(size[app], k[app] - len(centres[app]))]))
    return centres


def _moved(rows: DataFrame, centres: dict[str, np.ndarray], tasks: int) -> dict[str, np.ndarray]:
    """Each centre at the mean of its rows; a centre without rows stays. Tasks send a sum for each (app, cluster), never rows."""
    def sums(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for app, _, x in _by_app(batch):
                if app not in centres:
                    continue
                c = centres[app]
                n, s = total.setdefault(app, (np.zeros(len(c), np.int64), np.zeros(c.shape)))
                label = _nearest(x, c)
                n += np.bincount(label, minlength=len(c))
                np.add.at(s, label, x)
        for app, (n, s) in total.items():
            there = np.flatnonzero(n)
            columns = [pa.array([app] * len(there)), pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(list(s[there]), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["appid", "cluster_id", "n", "total"])

    parts = rows.select("appid", F.col("emb").cast("array<double>").alias("emb")).mapInArrow(sums, "appid string, cluster_id int, n long, total array<double>")
    if tasks * sum(c.nbytes for c in centres.values()) > CENTRE_BYTES:  # else the driver adds them up
        def added(table):
            total = np.stack(table["total"]).sum(0)
            return table.head(1).assign(n=table["n"].sum(), total=[total])

        parts = parts.groupBy("appid", "cluster_id").applyInPandas(added, parts.schema)
    moved = {app: (np.zeros(len(c), np.int64), np.zeros(c.shape)) for app, c in centres.items()}
    for r in sorted(parts.collect(), key=lambda r: (r.appid, r.cluster_id, r.n, r.total)):  # one order, so one sum, on every run
        n, s = moved[r.appid]
        n[r.cluster_id] += r.n
        s[r.cluster_id] += r.total
    return {app: np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[app]) for app, (n, s) in moved.items()}


def assign_clusters(rows: DataFrame, rounds: int = ROUNDS, starts: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(appid, reviewId, cluster_id, cluster_size) from (appid, reviewId, emb): k-means of every app at once, k by cluster_count.

    Starts are drawn by hash and distance (`_started`) unless given. A round assigns every row to its nearest centre (distances to nine places, ties
    to the smaller number) and moves the centres to the means; an app stops when its centres stay, all after `rounds`. Rows are read
    where they lie, a task sends sums, and centres go to the tasks. Centres of all apps of a batch take CENTRE_BYTES at most; with more apps
    there are more batches, each a folder of its own that its rounds read alone.

    Rows without app, id or vector, or with a null or non-finite component, take no part; repeated ids are rows of their own;
    an app with fewer different vectors than k has fewer clusters; an empty table gives no rows. All vectors have one length.
    """
    sound = "appid IS NOT NULL AND reviewId IS NOT NULL AND emb IS NOT NULL AND forall(emb, v -> v IS NOT NULL AND abs(v) < double('Infinity'))"
    rows = rows.select("appid", "reviewId", "emb").filter(sound)
    schema = "appid string, reviewId string, cluster_id int"
    counts = saved(cluster_count(rows), "cluster_counts")
    total = counts.agg(F.sum("k").alias("k")).crossJoin(rows.select(F.size("emb").alias("d")).limit(1)).first()  # one row and one row
    batches = 1 + (total.k * total.d * 8) // CENTRE_BYTES if total else 1
    numbered = F.pmod(F.xxhash64("appid"), F.lit(batches)).cast("int")
    kept = saved(rows.withColumn("batch", numbered), "vectors", "batch")
    out = None
    for i in range(batches):
        some = kept.filter(F.col("batch") == i)
        tasks = some.rdd.getNumPartitions()
        k = {r.appid: r.k for r in counts.filter(numbered == i).collect()}
        centres = {app: np.asarray(c, float) for app, c in starts.items() if app in k} if starts else _started(some, k)
        moving = centres
        for _ in range(rounds):
            moved = _moved(some, moving, tasks) if moving else {}
            centres = centres | moved
            moving = {app: c for app, c in moved.items() if not np.array_equal(c, moving[app])}
            if not moving:
                break

        def labelled(batches, centres=centres):
            for batch in batches:
                label = np.zeros(len(batch), np.int32)
                for app, places, x in _by_app(batch):
                    label[places] = _nearest(x, centres[app])
                yield pa.RecordBatch.from_arrays([batch.column("appid"), batch.column("reviewId"), pa.array(label)], ["appid", "reviewId", "cluster_id"])

        found = some.select("appid", "reviewId", "emb").mapInArrow(labelled, schema)
        out = found if out is None else out.unionByName(found)
    return with_sizes(saved(out, "clusters"))


def with_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.join(assigned.groupBy("appid", "cluster_id").agg(F.count("*").alias("cluster_size")), ["appid", "cluster_id"])


def medoids(assigned: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(appid, cluster_id, rep_reviewId, cluster_size): the member nearest to the cluster's mean, ties to the smaller id.

    Members without a vector do not count; a repeated id counts as often as it is there.
    """
    rows = assigned.join(embeddings.select("appid", "reviewId", F.col("emb").cast("array<double>").alias("emb")).filter("emb IS NOT NULL"), ["appid", "reviewId"])
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    # vectors are summed on each task before the shuffle
    means = rows.groupBy("appid", "cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector("emb"))).alias("mean"))
    square = F.aggregate(F.zip_with("emb", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    near = rows.join(means, ["appid", "cluster_id"]).withColumn("d", F.round(square, 12))
    return near.groupBy("appid", "cluster_id").agg(F.min_by("reviewId", F.struct("d", "reviewId")).alias("rep_reviewId"), F.count("*").alias("cluster_size"))


def summaries(assigned: DataFrame, reviews: DataFrame, longest: int = 3, most: int = 400) -> DataFrame:
    """(appid, cluster_id, summary_text, summary_n_reviews, source_reviewIds) from each cluster's longest texts."""
    rows = assigned.select("appid", "cluster_id", "reviewId").join(reviews.select("appid", "reviewId", F.coalesce("text", F.lit("")).alias("text")), ["appid", "reviewId"])
    place = F.row_number().over(W.partitionBy("appid", "cluster_id").orderBy(F.desc(F.length("text")), "reviewId"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= longest)
    both = kept.groupBy("appid", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "text", "reviewId"))).alias("s"))  # at most `longest` rows each
    text = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    return both.select("appid", "cluster_id", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text).alias("summary_text"), F.size("s").alias("summary_n_reviews"), F.array_join(F.transform("s", lambda x: x["reviewId"]), ",").alias("source_reviewIds"))


def scoring_units(cluster_summaries: DataFrame | None, reps: DataFrame | None, embeddings: DataFrame, source: str = "auto") -> DataFrame:
    """(appid, unit_id, level, text): cluster summaries if there are any (or asked for), else the representatives' texts."""
    if source == "summaries" or (source == "auto" and cluster_summaries is not None and not cluster_summaries.isEmpty()):
        rows = cluster_summaries.select("appid", F.lit("cluster").alias("level"), unit_id(F.lit("cluster"), F.col("appid"), F.col("cluster_id")).alias("unit_id"), F.col("summary_text").alias("text"))
    else:
        texts = embeddings.select("appid", F.col("reviewId").alias("rep_reviewId"), "text")
        rows = reps.join(texts, ["appid", "rep_reviewId"], "left").select("appid", F.lit("review").alias("level"), unit_id(F.lit("review"), F.col("appid"), F.col("rep_reviewId")).alias("unit_id"), "text")
    return rows.filter(long_enough(F.col("text"))).select("appid", "unit_id", "level", "text")
