import random

from graphs import COMP8, graph, mapping
from pyspark.sql import functions as F

from arcweave.functions import adjacency, codes

GOLDEN = {  # x: gamma, delta, nibble, zeta_3
    1: ("1", "1", "1001", "100"),
    2: ("010", "0100", "1010", "1010"),
    3: ("011", "0101", "1011", "1011"),
    4: ("00100", "01100", "1100", "1100"),
    8: ("0001000", "00100000", "00011000", "0100000"),
    16: ("000010000", "001010000", "00101000", "01010000"),
}


def test_goldens(spark):
    x = F.col("x")
    found = spark.createDataFrame([(k,) for k in GOLDEN], "x long").select("x", codes.gamma(x), codes.delta(x), codes.nibble(x), codes.zeta(x, 3))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == GOLDEN
    small = spark.range(5).select(codes.minimal_binary(F.col("id"), F.lit(5).cast("long")))
    assert [r[0] for r in small.collect()] == ["00", "01", "10", "110", "111"]
    assert spark.range(1).select(codes.gamma(F.col("id"))).first()[0] is None


def test_round_trips(spark):
    draw = random.Random(0)
    numbers = sorted({*range(1, 70), *(draw.randrange(1, 2 ** draw.randint(1, 40)) for _ in range(200))})
    x = F.col("x")
    df = spark.createDataFrame([(k,) for k in numbers], "x long")
    for encode, decode in ((codes.gamma, codes.gamma_decode), (codes.delta, codes.delta_decode), (codes.nibble, codes.nibble_decode)):
        assert [r[0] for r in df.select(encode(x).alias("w")).select(decode(F.col("w"))).collect()] == numbers
    for k in (1, 2, 3, 5):
        assert [r[0] for r in df.select(codes.zeta(x, k).alias("w")).select(codes.zeta_decode(F.col("w"), k)).collect()] == numbers
    for z in (1, 2, 3, 7, 8, 13):
        pairs = spark.range(z).withColumn("z", F.lit(z).cast("long"))
        assert [r[0] for r in pairs.select("z", codes.minimal_binary(F.col("id"), F.col("z")).alias("w")).select(codes.minimal_binary_decode(F.col("w"), F.col("z"))).collect()] == list(range(z))


def test_sequences(spark):
    df = spark.createDataFrame([("AAAAAABBBB",), ("ABA",)], "s string").withColumn("a", F.split("s", ""))
    assert [[tuple(x) for x in r[0]] for r in df.select(codes.run_lengths(F.col("a"))).collect()] == [[("A", 6), ("B", 4)], [("A", 1), ("B", 1), ("A", 1)]]
    assert [r[0] for r in df.select(F.array_join(codes.run_lengths_decode(codes.run_lengths(F.col("a"))), "")).collect()] == ["AAAAAABBBB", "ABA"]
    banana = spark.createDataFrame([(list("banana"), list("abn"))], "s array<string>, a array<string>")
    places = banana.select("a", codes.move_to_front(F.col("s"), F.col("a")).alias("p"))
    assert places.first()["p"] == [1, 1, 2, 1, 1, 1]
    assert "".join(places.select(codes.move_to_front_decode(F.col("p"), F.col("a"))).first()[0]) == "banana"
    bits = ["1", "0", "1110011", "0001", "10101"]
    df = spark.createDataFrame([(b,) for b in bits], "b string")
    assert df.select(codes.binary_runs(F.col("b"))).collect()[2][0] == [3, 3, 1, 1]
    assert [r[0] for r in df.select(codes.binary_runs(F.col("b")).alias("c")).select(codes.binary_runs_decode(F.col("c"))).collect()] == bits


def test_huffman(spark):
    found = codes.huffman_codes({"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5})
    assert sum(len(found[s]) * n for s, n in {"a": 45, "b": 13, "c": 12, "d": 16, "e": 9, "f": 5}.items()) == 224
    assert not any(a != b and b.startswith(a) for a in found.values() for b in found.values())
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "s string")
    assert {r["symbol"]: (r["n"], len(r["code"])) for r in codes.huffman(df, "s").collect()} == {"x": (2, 1), "y": (1, 1)}


def test_adjacency(spark):
    lists = adjacency.adjacency_lists(graph(spark, COMP8))
    near = mapping(lists)
    assert near[2] == [1, 3, 4] and near[3] == [1, 2, 4, 5] and near[4] == [2, 3, 5, 6]
    gaps = adjacency.gap_encode(lists)
    assert mapping(gaps) == {1: [1, 1], 2: [-1, 2, 1], 3: [-2, 1, 2, 1], 4: [-2, 1, 2, 1], 5: [-2, 1, 2, 1], 6: [-2, 1, 2, 1], 7: [-2, 1, 2], 8: [-2, 1]}
    assert mapping(adjacency.gap_decode(gaps)) == near
    encoded = adjacency.interval_encode(lists, 2)
    assert mapping(adjacency.interval_decode(encoded, 2)) == near
    pair = spark.createDataFrame([([2, 3, 5, 6], [1, 3, 4])], "n array<long>, t array<long>").select("n", "t", adjacency.reference_encode_pair(F.col("n"), F.col("t")).alias("e"))
    mask, residual = pair.first()["e"]
    assert mask == "101" and residual == [2, 5, 6]
    assert pair.select(adjacency.reference_decode_pair(F.col("e.mask"), F.col("e.residual"), F.col("t"))).first()[0] == [2, 3, 5, 6]
    chosen = {r["id"]: r for r in adjacency.reference_encode(lists).collect()}
    for v, r in chosen.items():
        theirs = near[r["reference"]] if r["reference"] else []
        assert sorted([x for x, m in zip(theirs, r["mask"], strict=True) if m == "0"] + r["residual"]) == near[v]
