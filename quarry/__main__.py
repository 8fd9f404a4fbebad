"""Programs on text files: python -m quarry PROGRAM ..., each printing or writing what it computes.

    knn TRAIN TEST K                       accuracy of k nearest neighbours
    svm TRAIN TEST C SIGMASQR [MAX_ITER]   accuracy of a support vector machine; also svm-shrinking, svm-approx
    fpgrowth FILE SUPPORT                  labels of the prefix tree in preorder
    kmeans FILE K                          centroids
    compute-distance, distance-to-similarity, evd, spectral-kmeans: the steps of spectral clustering, by options
    train FILE                             a network on a CSV
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import densify
from quarry.operators import kmeans, knn, metrics, network, prefix_tree, prep, spectral, svm
from quarry.sources import text


def _dense(rows, dims: int):
    return rows.select(*[c for c in ("id", "label") if c in rows.columns], densify("features", dims).alias("vector"))


def _dims(*tables) -> int:
    return max(text.max_dimension(t).first()["max_dim"] for t in tables)


def run_knn(spark, a) -> str:
    train, test = text.read_labelled(spark, a.train), text.read_labelled(spark, a.test)
    d = _dims(train, test)
    got = metrics.accuracy(knn.classify(_dense(test, d), _dense(train, d), a.k, a.vote)).first()
    return f"accuracy {got['accuracy']}"


def run_svm(spark, a) -> str:
    train, test = text.read_labelled(spark, a.train), text.read_labelled(spark, a.test)
    d = _dims(train, test)
    fit = {"svm": svm.fit, "svm-shrinking": svm.fit_shrinking, "svm-approx": svm.fit_approximate}[a.program]
    model = fit(_dense(train, d), a.c, a.sigmasqr, max_iter=a.max_iter)
    got = svm.evaluate(svm.decision(_dense(test, d), model)).first()
    return f"iterations {model.iterations} threshold {model.threshold:.6g} accuracy {got['accuracy']}"


def run_fpgrowth(spark, a) -> str:
    baskets = text.read_transactions(spark, a.file)
    found = prefix_tree.paths(baskets, prefix_tree.item_rank(baskets, a.support))
    labels, _ = prefix_tree.serialize(prefix_tree.tree_nodes(found), prefix_tree.root_count(found).first()["cnt"])
    return " ".join(map(str, labels))


def run_kmeans(spark, a) -> str:
    rows = text.read_unlabelled(spark, a.file)
    centroids, _ = kmeans.fit(_dense(rows, _dims(rows)), a.k)
    lines = text.centroid_lines(kmeans.centroid_table(spark, centroids)).orderBy("cluster").collect()
    return "\n".join(r["value"] for r in lines)


def run_compute_distance(spark, a) -> str:
    docs = text.read_documents(spark, a.input)
    text.write_edges(spectral.tnn_graph(_dense(docs, _dims(docs)), a.t_nearest_neighbor), a.output, docs.select("id"))
    return ""


def run_similarity(spark, a) -> str:
    edges = text.read_edges(spark, a.input)
    out = spectral.normalize(spectral.similarity(spectral.symmetric_closure(edges)))
    text.write_edges(out, a.output)
    return ""


def run_evd(spark, a) -> str:
    values, vectors, _ = spectral.eigenpairs(text.read_edges(spark, a.input), a.eigenvalue, a.eigenspace, a.kind, a.max_iterations, a.tolerance)
    text.write_values(spark, values, a.eigenvalues_output)
    text.write_vectors(vectors, a.eigenvectors_output)
    return ""


def run_spectral_kmeans(spark, a) -> str:
    rows = text.read_vectors(spark, a.input)
    text.write_memberships(kmeans.memberships(rows, a.num_clusters, init=a.init, rounds=a.max_loop), a.output)
    return ""


def run_train(spark, a) -> str:
    rows = prep.read_csv(spark, a.file, a.valid_pct, a.test_pct)
    train = rows.filter(F.col("part") == "train")
    one = rows.select(F.size("x").alias("d"), F.size("onehot").alias("c")).first()
    net = network.Network(one["d"], one["c"], a.hidden)
    history = network.Trainer(net, a.rate).fit(prep.batches(train, a.train_batch, 0).cache(), a.epochs, network.n_full_batches(train.count(), a.train_batch), a.time)
    said = [f"epoch {h['epoch']} loss {h['loss']:.6g} accuracy {h['accuracy']:.4g}" for h in history]
    test = rows.filter(F.col("part") == "test")
    got = metrics.top_k_accuracy(network.predict(test, net), 1).first()
    return "\n".join([*said, f"test accuracy {got['accuracy']}"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    programs = top.add_subparsers(dest="program", required=True)

    def add(name: str, run, *positional: tuple[str, type], **options):
        p = programs.add_parser(name)
        for arg, kind in positional:
            p.add_argument(arg, type=kind)
        for option, default in options.items():
            p.add_argument(f"--{option}", default=default, type=type(default) if default is not None else str, required=default is None)
        p.set_defaults(run=run)
        return p

    add("knn", run_knn, ("train", str), ("test", str), ("k", int), vote="majority")
    for name in ("svm", "svm-shrinking", "svm-approx"):
        p = add(name, run_svm, ("train", str), ("test", str), ("c", float), ("sigmasqr", float))
        p.add_argument("max_iter", type=int, nargs="?", default=100_000)
    add("fpgrowth", run_fpgrowth, ("file", str), ("support", float))
    add("kmeans", run_kmeans, ("file", str), ("k", int))
    add("compute-distance", run_compute_distance, input=None, output=None, t_nearest_neighbor=10)
    add("distance-to-similarity", run_similarity, input=None, output=None)
    add("evd", run_evd, input=None, eigenvalue=2, eigenspace=5, eigenvalues_output=None, eigenvectors_output=None, kind="LA", max_iterations=300, tolerance=1e-10)
    add("spectral-kmeans", run_spectral_kmeans, input=None, output=None, num_clusters=2, init="first", max_loop=20)
    p = add("train", run_train, ("file", str), valid_pct=10.0, test_pct=10.0, epochs=2, train_batch=100, rate=0.5)
    p.add_argument("--hidden", type=int, nargs="*", default=[])
    p.add_argument("--time", type=float, default=None)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    out = a.run(spark, a)
    if out:
        print(out)
    return out


if __name__ == "__main__":
    main()
