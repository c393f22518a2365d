"""Normalisation pins, pairwise rules, and trim against a brute-force
greedy pass on small fixtures."""

import random

import greedy_reference as G
from logsieve.functions.similarity import normalize
from logsieve.operators.dedup import trim, trim_report
from logsieve.functions.parse import parse_lines
from pyspark.sql import functions as F

PINS = [
    ("uuid 550e8400-e29b-41d4-a716-446655440000 end", "uuid ID_SHORT-e29b-41d4-a716-ID end"),
    ("addr 10.20.30.40 up", "addr IP up"),
    ("addr 10.0.0.1:8065 up", "addr PATH up"),
    ("v 1.2.3 ok", "v PATH ok"),
    ("took 150ms and 2.5s and 7ns and 9us", "took DURATION_MS and DURATION_S and DURATION_NS and DURATION_US"),
    ("at 2025-01-02 03:04:05.678 done", "at DATE TIME done"),
    ("facade decade 12345678 123456 42", "ID ID ID_SHORT ID NUMBER"),
    ("said \"hi 3\" and 'x' in web/handlers.go:187", "said STRING and STRING in web/PATH:NUMBER"),
    ("3sources 1234567890123 x", "DURATION_Sources ID x"),
    ("édecade1 naïve", "éID naïve"),
]


def test_normalisation_pins(spark):
    df = spark.createDataFrame([(m,) for m, _ in PINS], "m string")
    got = [r[0] for r in df.select(normalize(F.col("m"))).collect()]
    assert got == [n for _, n in PINS]
    assert [G.normalize(m) for m, _ in PINS] == [n for _, n in PINS]


def _entries(spark, rows):
    ddl = ("file_path string, ord struct<f:bigint,n:string,p:bigint,s:bigint>, ts timestamp_ntz, "
           "wall_ts timestamp_ntz, tz_offset string, level string, message string, source string, "
           "user string, log_source string, ack_id string, type string, status string, "
           "extras map<string,string>, duplicate_count bigint")
    data = [("f", (0, "f", i, 0), None, None, "+00:00", lvl, msg, src, "", "", "", "", "", {}, 0)
            for i, (lvl, src, msg) in enumerate(rows)]
    return spark.createDataFrame(data, ddl)


def test_three_identical_lines(spark, lines_df):
    line = 'info [2025-01-01 11:00:00.000 Z] System check complete caller="system/checks.go:42" status="ok"'
    e = parse_lines(lines_df([line] * 3)).withColumn(
        "ord", F.struct(F.lit(0).cast("bigint").alias("f"), F.lit("x").alias("n"),
                        F.monotonically_increasing_id().alias("p"), F.lit(0).cast("bigint").alias("s"))
    ).withColumn("file_path", F.lit("x"))
    out = trim(e).collect()
    assert len(out) == 1 and out[0].duplicate_count == 3
    rep = trim_report(e, trim(e)).collect()[0]
    assert (rep.original, rep.final, rep.removed) == (3, 1, 2)


WORDS = ["connection", "failed", "timeout", "user", "login", "cache", "hit", "miss", "db", "retry",
         "request", "error", "ok", "42", "1.2.3", "0xdeadbeef", "handler", "api/v4/users", "ms", "é"]


def _random_rows(seed, n):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8))) for _ in range(12)]
    rows = []
    for _ in range(n):
        msg = rnd.choice(base)
        if rnd.random() < 0.5:
            ws = msg.split()
            k = rnd.randrange(len(ws))
            if rnd.random() < 0.5:
                ws[k] = rnd.choice(WORDS)
            else:
                ws.insert(k, rnd.choice(WORDS))
            msg = " ".join(ws)
        if rnd.random() < 0.1:
            msg = rnd.choice(["x", "timeoutx", "db retry"]) + rnd.choice(["", " y"])
        rows.append((rnd.choice(["info", "INFO", "error"]),
                     rnd.choice(["a/b.go:1", "a/b.go:2", "A/B.GO:1", "", "zz/q.go:9"]), msg))
    return rows


def test_trim_matches_greedy_on_random_fixtures(spark):
    for seed in (1, 2, 3):
        rows = _random_rows(seed, 150)
        got = sorted((r.ord.p, r.duplicate_count) for r in trim(_entries(spark, rows)).collect())
        exp = sorted(G.greedy([(i, lvl, src, msg) for i, (lvl, src, msg) in enumerate(rows)]))
        assert got == exp, seed


def test_long_chain_needs_many_rounds(spark):
    letters = "ghijklmnopqrstuvwxyz"
    vocab = [f"w{a}{b}" for a in letters for b in letters][:80]
    rows = [("info", "svc/a.go:1", " ".join(vocab[i:i + 10])) for i in range(60)]
    got = sorted((r.ord.p, r.duplicate_count) for r in trim(_entries(spark, rows)).collect())
    exp = sorted(G.greedy([(i, lvl, src, msg) for i, (lvl, src, msg) in enumerate(rows)]))
    assert got == exp and len(exp) == 30


def test_equal_messages_across_many_sources(spark):
    rnd = random.Random(7)
    stems = ["api/users.go", "api/user.go", "app/login.go", "db/conn.go", "x", "ab", "abc", "abcd"]
    rows = []
    for i in range(120):
        src = rnd.choice(stems) + (f":{rnd.randint(1, 30)}" if rnd.random() < 0.8 else "")
        rows.append(("warn", src, rnd.choice(["cache miss", "cache miss for key", "db timeout"])))
    got = sorted((r.ord.p, r.duplicate_count) for r in trim(_entries(spark, rows)).collect())
    exp = sorted(G.greedy([(i, lvl, src, msg) for i, (lvl, src, msg) in enumerate(rows)]))
    assert got == exp


def test_shares_do_not_change_the_result(spark):
    rows = _random_rows(11, 140)
    exp = sorted(G.greedy([(i, lvl, src, msg) for i, (lvl, src, msg) in enumerate(rows)]))
    for share in (1, 3, 1 << 20):
        got = sorted((r.ord.p, r.duplicate_count) for r in trim(_entries(spark, rows), share=share, growth=2).collect())
        assert got == exp, share


def test_late_cluster_costs_in_proportion_to_its_size(spark, monkeypatch):
    """Copies of one template at the end of the input: about one candidate a copy."""
    from logsieve.operators import dedup

    def rows(n):
        rnd = random.Random(n)
        word = lambda: "".join(rnd.choice("ghijklmnopqrst") for _ in range(7))
        own = [("info", "a.go:1", " ".join(word() for _ in range(8))) for _ in range(200)]
        stem = [word() for _ in range(12)]
        return own + [("info", "b.go:2", " ".join(stem[:5] + [word()] + stem[5:])) for _ in range(n)]

    counts, made = [], dedup.Keys.candidates

    def counted(self, first=None):
        out = made(self, first)
        counts[-1] += out.count()
        return out

    monkeypatch.setattr(dedup.Keys, "candidates", counted)
    for n in (500, 2000):
        counts.append(0)
        out = sorted(r.duplicate_count for r in trim(_entries(spark, rows(n))).collect())
        assert out == [1] * 200 + [n]
    assert counts[0] < 20 * 500 and counts[1] < 20 * 2000, counts


def test_candidates_grow_with_the_nodes_not_their_pairs(spark):
    from logsieve.operators.dedup import Keys, _node_attrs, entry_nodes, numbered
    from logsieve.session import written

    def name(i):
        return "".join(chr(103 + (i * 7919 >> (4 * k)) % 16) for k in range(6)) + chr(103 + i % 16)

    for form in ("failed for %s", "worker_%s"):
        counts = []
        for n in (150, 300):
            nodes = numbered(entry_nodes(_entries(spark, [("info", "a.go:1", form % name(i)) for i in range(n)])))
            attrs = _node_attrs(written(nodes, "test-nodes"))
            counts.append(Keys(attrs).candidates().count())
        assert counts[1] < 3 * max(counts[0], 150) and counts[1] < 300 * 299 / 20, (form, counts)


def test_counts_beyond_an_int(spark):
    big = _entries(spark, [("info", "a", "x"), ("info", "a", "x")])
    assert dict(trim(big).dtypes)["duplicate_count"] == "bigint"


def test_appended_deliveries_give_the_trim_of_the_whole(spark):
    from logsieve.operators.dedup import trim_appended, trimmed_entries

    rows = _random_rows(21, 160)
    rows[90:94] = [("info", "", ""), ("info", "", "x"), ("INFO", "", "x"), rows[3]]
    e = _entries(spark, rows)
    leaders = None
    for lo, hi in ((0, 50), (50, 51), (51, 51), (51, 120), (120, 160)):
        leaders = trim_appended(leaders, e.where(f"ord.p >= {lo} and ord.p < {hi}"))
    got = sorted((r.ord.p, r.duplicate_count) for r in trimmed_entries(leaders).collect())
    assert got == sorted(G.greedy([(i, lvl, src, msg) for i, (lvl, src, msg) in enumerate(rows)]))


def test_long_messages_use_prefixes_by_size(spark):
    """Messages beyond 32 words, repeats included, against the greedy pass."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("ghijklmnopqrst") for _ in range(4)) for _ in range(60)]
    rows = []
    for k in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(30, 110))]
        for _ in range(rnd.randrange(1, 7)):
            w = list(base)
            for _ in range(rnd.randrange(0, len(w) // 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab[:8]) if rnd.random() < 0.5 else rnd.choice(vocab)
            if rnd.random() < 0.3:
                w = w[:len(w) * 2 // 3]
            rows.append(("info", "a.go:1", " ".join(w)))
    rnd.shuffle(rows)
    got = sorted((r.ord.p, r.duplicate_count) for r in trim(_entries(spark, rows)).collect())
    assert got == sorted(G.greedy([(i, lvl, src, msg) for i, (lvl, src, msg) in enumerate(rows)]))


def test_long_messages_meet_in_blocks(spark):
    """Messages of one vocabulary emit no prefix keys, and candidates lose no similar pair; the
    edit distance of long texts is the plain one."""
    from logsieve.functions.similarity import edit_distance
    from logsieve.operators.dedup import Keys, _node_attrs, entry_nodes, numbered, similar_edges
    from logsieve.session import written

    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("ghijklmnop") for _ in range(5)) for _ in range(150)]
    texts = []
    for _ in range(4):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(90, 110))]
        texts.append(" ".join(base))
        for share in (0.05, 0.3):
            texts.append(" ".join(rnd.choice(vocab) if rnd.random() < share else x for x in base))
    nodes = written(numbered(entry_nodes(_entries(spark, [("info", "a.go:1", x) for x in texts]))), "test-nodes")
    attrs = written(_node_attrs(nodes), "test-attrs")
    keys = Keys(attrs)
    assert keys.earlier.count() == keys.later.count() == 0
    got = {(r.a, r.b) for r in similar_edges(attrs, keys.candidates()).collect()}
    assert got == {(i, j) for j in range(len(texts)) for i in range(j) if G.similar(texts[i], texts[j])} and got
    for a, b in ((texts[0], texts[1]), (texts[0], texts[2]), (texts[0], texts[3])):
        a, b = a.encode(), b.encode()
        d, most = G.lev(a, b), max(len(a), len(b)) // 5 + 1
        assert edit_distance(a, b, most) == (d if d <= most else -1)


def test_unlike_long_texts_are_told_apart_early(monkeypatch):
    from logsieve.functions import similarity

    rng = random.Random(5)
    a, b = (" ".join(rng.choice(["alpha", "bet", "gamma", "delta", "eps", "zeta"]) for _ in range(900)).encode()
            for _ in range(2))
    distances, cells = similarity._distances, []

    def counted(pattern, text, anywhere=False):
        cells.append(len(pattern) * len(text))
        return distances(pattern, text, anywhere)

    monkeypatch.setattr(similarity, "_distances", counted)
    most = max(len(a), len(b)) // 10
    assert similarity.edit_distance(a, b, most) == -1
    # a piece's places span ``most`` bytes, not twice as many
    assert max(cells) <= (len(a) // 16 + 1) * (most + len(a) // 16 + 400)
    for _ in range(30):
        c = bytearray(a[:700])
        for _ in range(rng.randrange(60)):
            at = rng.randrange(len(c) - 9)
            c[at:at + rng.randrange(4)] = b"xyz"[:rng.randrange(4)]
        c = bytes(c) if rng.random() < 0.5 else bytes(c)[rng.randrange(40):]
        *_, d = distances(a[:700], c)
        for most in (d - 1, d, d + 1, d + 50):
            if most >= 0:
                assert similarity.edit_distance(a[:700], c, most) == (d if d <= most else -1)
                assert similarity.edit_distance(c, a[:700], most) == (d if d <= most else -1)


def _prose(seed, n):
    """Messages of one vocabulary, some of them changed copies of earlier ones."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("ghijklmnop") for _ in range(5)) for _ in range(150)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            share = rnd.choice((0.05, 0.12, 0.3))
            texts.append(" ".join(rnd.choice(vocab) if rnd.random() < share else x for x in rnd.choice(texts).split()))
        else:
            texts.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(60, 130))))
    return texts


def test_pairs_meet_in_rounds(spark, monkeypatch):
    """Blocks and texts are sent in rounds that shuffle all nodes about once, whatever the number of
    block pairs; no pair is lost, and tables between the steps are deleted."""
    import os

    from logsieve.operators import dedup
    from logsieve.session import ensure_checkpoint_dir

    names, made = [], dedup.written

    def named(df, name, *more):
        names.append(name)
        return made(df, name, *more)

    texts = _prose(3, 40)
    nodes = dedup.numbered_nodes(dedup.entry_nodes(_entries(spark, [("info", "a.go:1", x) for x in texts])))
    monkeypatch.setattr(dedup, "written", named)
    monkeypatch.setattr(dedup, "_CELL", 4)
    monkeypatch.setattr(dedup, "_BLOCK_WORDS", (300, 300))
    monkeypatch.setattr(dedup, "_ROUND_WORDS", 1)
    monkeypatch.setattr(dedup, "_ROUND_TEXT", 1)
    root = ensure_checkpoint_dir(spark).removeprefix("file:") + "/written"
    before = set(os.listdir(root))
    pairs = dedup.similar_edges(dedup._node_attrs(nodes))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"edges"} and len(os.listdir(root)) == len(before) + 1
    assert names.count("block-candidates") > 5
    exp = {(i, j) for j in range(len(texts)) for i in range(j) if G.similar(texts[i], texts[j])}
    assert {(r.a, r.b) for r in pairs.collect()} == exp and len(exp) > 20
    # pairs of few nodes, and of all, go by different ways
    monkeypatch.setattr(dedup, "_FEW_PAIRS", 0)
    assert {(r.a, r.b) for r in dedup.similar_edges(dedup._node_attrs(nodes)).collect()} == exp


def test_trim_leaves_its_result_only(spark):
    import glob

    from logsieve.operators.dedup import trim_appended, trimmed_entries
    from logsieve.session import ensure_checkpoint_dir

    e = _entries(spark, _random_rows(4, 60))
    at = ensure_checkpoint_dir(spark).removeprefix("file:") + "/written/*"
    before = set(glob.glob(at))
    leaders = trim_appended(None, e.where("ord.p < 40"))
    assert len(set(glob.glob(at)) - before) == 1
    leaders = trim_appended(leaders, e.where("ord.p >= 40"))
    assert len(set(glob.glob(at)) - before) == 2
    assert sum(r.duplicate_count for r in trimmed_entries(leaders).collect()) == 60


def test_few_and_many_edges_settle_alike(spark, monkeypatch):
    from logsieve.operators import dedup

    rnd = random.Random(6)
    edges = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)})
    gone = set()
    for a, b in sorted(edges, key=lambda e: e[1]):
        if a not in gone:
            gone.add(b)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for few in (dedup._FEW_EDGES, 20, 0):
        monkeypatch.setattr(dedup, "_FEW_EDGES", few)
        got = [r.seq for r in dedup._settle(df).collect()]
        assert sorted(got) == sorted(gone), few
    assert dedup._settle(df.limit(0)).collect() == []
