"""Worked graphs: text of ``u>v:w`` arcs or ``u-v`` edges, in input order."""

import re

from arcweave.graph import Graph

WALK7 = "0>1:4 0>2:1 2>1:2 1>3:5 2>3:8 3>4:3 4>2:1 5>6:2"
MEET6 = "1>2:3 2>3:3.5 3>6:3 1>4:5 4>6:5"
SPLIT4 = "1>2:1 3>4:1"
COMP8 = "2-1 4-2 3-1 3-2 3-4 5-4 5-3 6-4 6-5 6-8 7-5 7-6 7-8"
TWOTRI = "1-2 2-3 3-1 3-4 4-5 5-6 6-4 6-7"
FLOWS = {  # name: (arcs, value, source side)
    "flow9a": ("a>b7 b>c8 d>a5 d>b9 e>b7 e>c5 d>f6 f>e8 g>e9 f>g11 s>a9 s>d8 c>t10 e>t6 g>t6", 14, "sabd"),
    "flow9b": ("s>a5 s>d8 a>b3 a>d3 b>c8 b>d9 c>t7 c>e5 d>f10 d>e4 e>t7 e>b7 f>g4 f>e8 g>e9 t>g6", 13, "s"),
    "flow4": ("s>a10 s>b5 a>t5 b>t10 a>b15", 15, None),
    "flow4bad": ("s>a99 s>b99 a>t99 b>t99 a>b1", 198, None),
}
BIPARTITE = "g-b c-b c-d f-g f-c g-e g-f b-a g-h e-c"
LETTERS = {"s": 0, "t": 1} | {c: k + 2 for k, c in enumerate("abcdefgh")}


def parse(text):
    out = []
    for k, part in enumerate(text.split()):
        u, sep, v, w = re.fullmatch(r"(\w+?)([>-])([a-z]|\d+?)(?::?([\d.]+))?", part).groups() if re.search(r"[a-z]", part) else re.fullmatch(r"(\d+)([>-])(\d+)(?::([\d.]+))?", part).groups()
        number = lambda x: LETTERS[x] if x in LETTERS else int(x)
        out.append((number(u), number(v), float(w or 0), k))
    return out


def graph(spark, text, directed=None):
    directed = ">" in text if directed is None else directed
    return Graph.from_edges(spark.createDataFrame(parse(text), "src long, dst long, weight double, ord long"), directed)


def random_edges(draw, most=12):
    n, m = draw.randint(2, most), draw.randint(1, 40)
    return [(draw.randrange(n), draw.randrange(n), float(draw.randint(1, 6)), k) for k in range(m)]


def made(spark, edges, directed=True):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double, ord long"), directed)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect()) if columns else sorted(tuple(r) for r in df.collect())


def mapping(df, key="id", value=None):
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}
