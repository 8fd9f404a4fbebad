"""Readers, writers, dataset preparation, networks and the programs."""

import gzip
import pickle
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.functions import vectors as V
from quarry.functions.plan import with_position
from quarry.operators import network, prep
from quarry.sources import files, images, netcdf, text
from quarry.streaming.scoring import score_stream


def put(path, content):
    path.write_text(content)
    return str(path)


def test_tokens(spark, tmp_path):
    path = put(tmp_path / "a.txt", "1 1:2.5  2:3\n\n3,1:2\t3:4\nabc 12abc .5 -1e2x\n7\n")
    rows = text.lines(spark, path).orderBy("id").collect()
    assert [r["t"] for r in rows] == [[1, 1, 2.5, 2, 3], [3, 1, 2, 3, 4], [0, 12, 0.5, -100], [7]]
    assert [r["id"] for r in rows] == [0, 1, 2, 3]
    assert text.n_rows(spark, path).first()["n"] == 4 and text.n_rows(spark, path, blank=True).first()["n"] == 5
    labelled = text.read_labelled(spark, path).orderBy("id").collect()
    assert labelled[0]["label"] == 1 and [tuple(p) for p in labelled[0]["features"]] == [(1, 2.5), (2, 3)]
    assert labelled[3]["label"] == 7 and labelled[3]["features"] == []
    stats = text.max_dimension(text.read_labelled(spark, path)).first()
    assert (stats["max_dim"], stats["max_width"], stats["n"]) == (12, 2, 4)
    assert text.dump(text.read_labelled(spark, path), 1) == "1 1:2.5 2:3"


def test_documents_and_edges(spark, tmp_path):
    path = put(tmp_path / "d.txt", "# head\n0:1 2:2\n\n1:3\n")
    docs = text.read_documents(spark, path).orderBy("id").collect()
    assert [(r["id"], r["norm_sq"]) for r in docs] == [(0, 5.0), (1, 9.0)]
    edges = spark.createDataFrame([(0, 1, 1 / 3), (0, 2, 123456.789), (2, 0, 1e-7), (2, 1, 0.0), (2, 3, 2.0), (2, 4, 999999.9)], "i bigint, j bigint, w double")
    ids = spark.range(3)
    text.write_edges(edges, str(tmp_path / "e"), ids)
    lines = [r["value"] for r in text.edge_lines(edges, ids).orderBy("i").collect()]
    assert lines == ["1:0.333333 2:123457", "", "0:1e-07 1:0 3:2 4:1e+06"]
    back = {(r["i"], r["j"]): r["w"] for r in text.read_edges(spark, str(tmp_path / "e")).collect()}
    assert back[0, 2] == 123457 and back[2, 0] == 1e-7


def test_positions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 7 % 1000).alias("x"))
    got = with_position(df, ["x"]).collect()
    assert all(r["x"] == r["pos"] for r in got)
    assert sorted(r["pos"] for r in with_position(df).collect()) == list(range(1000))
    assert with_position(df.limit(0), ["x"]).count() == 0


def test_file_order(spark, tmp_path):
    for k in range(3):  # the later a file, the larger: Spark reads large ones first
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k} {i}\n" + "\n" * (i % 2) for i in range(40 * (k + 1))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    try:
        rows = text.lines(spark, str(tmp_path)).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r["t"]) for r in rows] == [(k, i) for k in range(3) for i in range(40 * (k + 1))] and [r["id"] for r in rows] == list(range(240))


def test_sparse_vectors(spark):
    df = spark.createDataFrame([([(1, 2.0), (3, 1.0)], [(1, 1.0), (2, 4.0)]), ([], [(2, 3.0)]), ([], [])], "a array<struct<idx:int,val:double>>, b array<struct<idx:int,val:double>>")
    got = df.select(V.sparse_dot("a", "b").alias("d"), V.sparse_sq_dist("a", "b").alias("s"), V.densify("a", 3).alias("x")).collect()
    assert [(r["d"], r["s"], r["x"]) for r in got] == [(2.0, 18.0, [2.0, 0.0, 1.0]), (0.0, 9.0, [0.0] * 3), (0.0, 0.0, [0.0] * 3)]
    one = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(V.divide("v", F.lit(0)).alias("n"), V.divide("v", F.lit(2)).alias("h"), V.add("v", "v").alias("s")).first()
    assert all(np.isnan(one["n"])) and one["h"] == [0.5, 1.0] and one["s"] == [2.0, 4.0]


def test_csv(spark, tmp_path):
    rows = [(1 if i % 3 else -1, i, 5) for i in range(20)]
    path = put(tmp_path / "c.csv", "\n".join(",".join(map(str, r)) for r in rows))
    out = prep.read_csv(spark, path, validation=25, test=10).orderBy("id").collect()
    assert [r["part"] for r in out] == ["train"] * 13 + ["validation"] * 5 + ["test"] * 2
    assert {r["label"] for r in out} == {0, 1} and out[0]["onehot"] == [1.0, 0.0]
    own = np.arange(13)
    assert np.allclose([r["x"][0] for r in out], (np.arange(20) - own.mean()) / own.std()) and out[3]["x"][1] == 5


def test_batches_and_choice(spark):
    df = spark.range(25)
    a, b = (prep.batches(df, 10, e, seed=3).collect() for e in (0, 1))
    assert sorted(r["id"] for r in a) == list(range(25)) and [sum(r["batch"] == k for r in a) for k in range(3)] == [10, 10, 5]
    assert {r["id"]: r["batch"] for r in a} != {r["id"]: r["batch"] for r in b}
    w = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0)], "id int, weight double")
    assert [prep.weighted_choice(w, u).first()["id"] for u in (0.0, 0.3, 0.7, 0.8)] == [0, 1, 1, 2]
    assert prep.weighted_choice(w.limit(0), 0.5).count() == 0


def cdf(version, unlimited):
    """A file with dims n and 3, a byte variable, an int variable and a short one."""
    n = 4
    count = (lambda x: struct.pack(">q", x)) if version == 5 else (lambda x: struct.pack(">I", x))
    offset = (lambda x: struct.pack(">i", x)) if version == 1 else (lambda x: struct.pack(">q", x))
    name = lambda s: count(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    data = np.arange(n * 3, dtype=np.uint8)
    labels = (np.arange(n) * 10).astype(">i4")

    def build(b1, b2):
        head = b"CDF" + bytes([version]) + count(n if unlimited else 0)
        head += struct.pack(">i", 10) + count(2) + name("n") + count(0 if unlimited else n) + name("w") + count(3)
        head += struct.pack(">i", 12) + count(1) + name("title") + struct.pack(">i", 2) + count(2) + b"hi\0\0"
        head += struct.pack(">i", 11) + count(2)
        head += name("data") + count(2) + count(0) + count(1) + struct.pack(">i", 0) + count(0) + struct.pack(">i", 1) + count(4) + offset(b1)
        head += name("labels") + count(1) + count(0) + struct.pack(">i", 0) + count(0) + struct.pack(">i", 4) + count(4) + offset(b2)
        return head

    size = len(build(0, 0))
    if unlimited:
        body = b"".join(data[i * 3 : i * 3 + 3].tobytes() + b"\0" + labels[i : i + 1].tobytes() for i in range(n))
        return build(size, size + 4) + body
    return build(size, size + 12) + data.tobytes() + labels.tobytes()


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("unlimited", [True, False])
def test_netcdf(spark, tmp_path, version, unlimited):
    path = tmp_path / "a.nc"
    path.write_bytes(cdf(version, unlimited))
    rows = netcdf.read_netcdf(spark, str(path), rows_per_partition=3).orderBy("id").collect()
    assert [(r["id"], list(r["data"]), r["label"]) for r in rows] == [(i, [3 * i, 3 * i + 1, 3 * i + 2], 10 * i) for i in range(4)]
    assert netcdf.describe(str(path))[0] == {"name": "data", "kind": "BYTE", "dims": ["n", "w"], "shape": [4, 3]}


def test_packed_files(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id % 3 as int) AS label", "array(cast(id as int), 200, 7) AS data")
    pack = lambda pdf: netcdf.pack(np.array(pdf["data"].tolist(), np.uint8), pdf["label"].to_numpy())
    for path in (str(tmp_path / "a"), f"file:{tmp_path}/b"):
        assert files.write_packed(df.repartition(3), path, pack, 4) == 10 and len(files.listed(path)) == 3
        rows = netcdf.read_netcdf(spark, path).orderBy("id").collect()
        assert [(r["id"], list(r["data"]), r["label"]) for r in rows] == [(i, [i, 200, 7], i % 3) for i in range(10)]
    assert files.write_packed(df.limit(0), str(tmp_path / "c"), pack) == 0 and files.listed(str(tmp_path / "c")) == []


def test_netcdf_refuses_others(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        netcdf.describe(str(tmp_path / "x"))


def test_images(spark, tmp_path):
    pixels = np.arange(5 * 4, dtype=np.uint8).reshape(5, 2, 2)
    (tmp_path / "i.gz").write_bytes(gzip.compress(struct.pack(">HBB3I", 0, 8, 3, 5, 2, 2) + pixels.tobytes()))
    (tmp_path / "l").write_bytes(struct.pack(">HBBI", 0, 8, 1, 5) + bytes([3, 1, 4, 1, 5]))
    df = images.read_idx(spark, str(tmp_path / "i.gz"), str(tmp_path / "l"))
    rows = df.orderBy("id").collect()
    assert [r["label"] for r in rows] == [3, 1, 4, 1, 5] and np.allclose(rows[1]["pixels"], np.arange(4, 8) / 255)
    assert [r["part"] for r in images.with_validation(df, 40).orderBy("id").collect()] == ["validation"] * 2 + ["train"] * 3
    assert np.allclose(images.mean_image(df), pixels.reshape(5, -1).mean(0) / 255)


def test_cifar(spark, tmp_path):
    for k, key in ((1, "labels"), (2, "fine_labels")):
        (tmp_path / f"b{k}").write_bytes(pickle.dumps({"data": np.full((2, 3072), k, np.uint8), key: [k, 9]}))
    rows = images.read_cifar(spark, [str(tmp_path / "b1"), str(tmp_path / "b2")], scale=False).orderBy("id").collect()
    assert [(r["label"], r["pixels"][0]) for r in rows] == [(1, 1.0), (9, 1.0), (2, 2.0), (9, 2.0)]
    with pytest.raises(pickle.UnpicklingError):
        images.parse_cifar(pickle.dumps(print))


def test_transform_images(spark):
    df = spark.createDataFrame([(0, [float(x) for x in range(18)], 1)], "id bigint, pixels array<float>, label int")
    out = images.transform_images(df, (2, 3, 3), (1, 1), mean=np.ones(18)).first()["pixels"]
    assert out == [3.0, 12.0]
    a, b = (images.transform_images(df, (2, 3, 3), (2, 2), random_seed=s).first()["pixels"] for s in (1, 1))
    assert a == b and len(a) == 8


def test_network_gradients():
    rng = np.random.default_rng(0)
    for net, x in ((network.Network(4, 3, [5]), rng.normal(size=(6, 4))), (network.Network(0, 3, [4], (5, 5, 2), [3, 2], 3), rng.normal(size=(6, 50))), (network.Network(0, 3, [4], (5, 5, 2), [3], 3, relu=True, uniform=True), rng.normal(size=(6, 50)))):
        y = np.array([0, 1, 2, 0, 1, 2])
        grads, _, _ = net.gradients(x, y)
        for p, g in zip(net.params, grads):
            flat, own = p.ravel(), g.ravel()
            for k in rng.choice(flat.size, min(4, flat.size), replace=False):
                old = flat[k]
                ends = []
                for d in (1e-5, -1e-5):
                    p.flat[k] = old + d
                    ends.append(network.loss_of(net.forward(x), y).sum())
                p.flat[k] = old
                assert abs((ends[0] - ends[1]) / 2e-5 - own[k]) < 1e-4


@pytest.mark.parametrize("parts", [1, 3])
def test_training(spark, parts):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-1, 0.5, (30, 2)), rng.normal(1, 0.5, (30, 2))])
    rows = [(i, [float(v) for v in a], int(i >= 30), 0) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x array<double>, label int, batch int").repartition(parts)
    net, own = network.Network(2, 2, [4], seed=2), network.Network(2, 2, [4], seed=2)
    sums, loss, _, n = network.gradient_sums(df, net)
    want, own_loss, _ = own.gradients(x, np.array([r[2] for r in rows]))
    assert n == 60 and abs(loss - own_loss) < 1e-9 and all(np.allclose(a, b) for a, b in zip(sums, want))
    history = network.Trainer(net, 1.0, momentum=0.9, l2=1e-4, bias_rate=2.0, schedule=lambda r, s: network.inverse_time_decay(r, s, 10, 0.1)).fit(df, 12, 1)
    assert history[-1]["loss"] < history[0]["loss"] and history[-1]["accuracy"] > 90
    assert network.predict(df, net).filter("loss is null").count() == 0


def test_lenet3(spark):
    trainer = network.lenet3()
    assert [p.shape for p in trainer.net.params] == [(5, 5, 1, 20), (20,), (5, 5, 20, 50), (50,), (2450, 500), (500,), (500, 10), (10,)]
    assert all(np.abs(p).max() <= m for p, m in zip(trainer.net.params, np.repeat(np.sqrt([6 / 21, 6 / 70, 6 / 2950, 6 / 510]), 2)))
    before = [p.copy() for p in trainer.net.params]
    trainer.update([np.zeros_like(p) for p in before], 1)  # decay alone
    assert all(np.allclose(p, b * (1 - 0.01 * 1e-4)) for p, b in zip(trainer.net.params, before))
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 2 * 5].repeat(8) + rng.normal(0, 0.1, 64)).tolist(), i % 2, 0) for i in range(40)]
    small = network.lenet3((8, 8, 1), 2)
    history = small.fit(spark.createDataFrame(rows, "id bigint, x array<double>, label int, batch int").repartition(2), 12, 1)
    assert history[-1]["loss"] < history[0]["loss"] and history[-1]["accuracy"] == 100.0


def test_schedules():
    assert network.step_decay(1.0, 20, 10) == pytest.approx(0.01)
    assert network.inverse_time_decay(1.0, 10, 10, 1.0) == 0.5
    assert network.exponential_decay(1.0, 2) == pytest.approx(0.999964**2)
    assert network.n_full_batches(95, 10) == 9 and network.n_full_batches(5, 10) == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id bigint, vector array<double>").write.parquet(str(tmp_path / "in"))
    from quarry.operators import kmeans

    stream = spark.readStream.schema("id bigint, vector array<double>").parquet(str(tmp_path / "in"))
    score_stream(stream, lambda df: kmeans.assign(df, np.array([[0.0], [5.0]])), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["cluster"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1]


def test_programs(spark, tmp_path):
    samples = "\n".join(f"{1 if i % 2 else -1} 1:{(i % 2) * 4 + i / 50:.3f} 2:{(i % 2) * 4 - i / 50:.3f}" for i in range(20))
    path = put(tmp_path / "s.txt", samples)
    assert main(["knn", path, path, "3"], spark) == "accuracy 100.0"
    for program in ("svm", "svm-shrinking", "svm-approx"):
        assert main([program, path, path, "1", "1"], spark).endswith("accuracy 100.0")
    assert main(["fpgrowth", put(tmp_path / "t.txt", "1 2\n2 3\n2\n"), "0.5"], spark) == "-2 2 -1"
    points = put(tmp_path / "p.txt", "1:1 2:1\n1:8 2:8\n1:1 2:2\n1:9 2:8\n")
    assert main(["kmeans", points, "2"], spark) == "1:1 2:1.5\n1:8.5 2:8"
    step = lambda name: str(tmp_path / name)
    main(["compute-distance", "--input", points, "--output", step("d"), "--t_nearest_neighbor", "2"], spark)
    main(["distance-to-similarity", "--input", step("d"), "--output", step("n")], spark)
    main(["evd", "--input", step("n"), "--eigenvalue", "2", "--eigenvalues_output", step("v"), "--eigenvectors_output", step("w")], spark)
    main(["spectral-kmeans", "--input", step("w"), "--output", step("m")], spark)
    assert text.read_memberships(spark, step("m")).count() == 4
    csv = put(tmp_path / "c.csv", "\n".join(f"{i % 2},{(i % 2) * 2 + (i * 7 % 10) / 20}" for i in range(40)))
    assert "test accuracy" in main(["train", csv, "--train_batch", "10", "--epochs", "1"], spark)
