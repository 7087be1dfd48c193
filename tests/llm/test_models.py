"""Held-out quality of the trained models, their gradients, and recall of the near-duplicate search."""

import zlib

import numpy as np

from keystrata.llm import langid, mixlm, neardup
from tests.conftest import SF_DIR


def test_gru_gradients():
    r = np.random.default_rng(0)
    net = langid.Network.start(["a", "b", "c"], 3)
    net.tables, net.recurrent = [a.astype(float) for a in net.tables], [a.astype(float) for a in net.recurrent]
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    text, label = r.integers(0, 256, (7, 5)).astype(np.uint8), r.integers(0, 3, 5)
    _, grads = langid.gradients(net, text, label)
    for a, g in zip(net.arrays(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was, values = a[at], []
        for step in (1e-5, -1e-5):
            a[at] = was + step
            values.append(langid.gradients(net, text, label)[0])
        a[at] = was
        assert abs((values[0] - values[1]) / 2e-5 - g[at]) < 1e-7


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = docs.join(langid.identify(docs), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_mixing_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = docs.join(mixlm.score_documents(docs), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    bits = -sum(r["score"] for r in held) / np.log10(2) / sum(len(r["text"].encode()) for r in held)
    base = -sum(r["base_score"] for r in held) / np.log10(2) / sum(len(r["text"].encode()) for r in held)
    assert bits < 0.985 * base  # bits a byte on held-out documents


def follow(text):
    """Counts of byte pairs of one text."""
    out = np.zeros((256, 256), np.int64)
    np.add.at(out, tuple(np.divmod(mixlm.pairs_of(text, np.array([0, len(text)])), 256)), 1)
    return out


def learned(train):
    tree, bits = mixlm.Tree(follow(train)), [18] * mixlm.PREDICTORS
    return mixlm.Model.start(tree, mixlm.tables_of(bits, mixlm.count_bits(tree, bits, train, np.array([0, len(train)]))))


def test_bits_make_a_distribution():
    """The chances of all next symbols add up to one."""
    r = np.random.default_rng(4)
    model = learned(r.integers(97, 110, 3000).astype(np.uint8))
    head = b"abcab"
    text = np.frombuffer(b"".join(head + bytes([s]) for s in range(256)), np.uint8)
    ends = np.arange(257) * 6
    whole = mixlm.costs(model, text, ends)
    first = mixlm.costs(model, np.frombuffer(head, np.uint8), np.array([0, 5]))
    assert abs(np.exp(-(whole - first)).sum() - 1) < 1e-3


def contexts_of(text, at):
    """What each predictor knows at a position of a lone text."""
    line = bytes(text[:at])
    word = line[line.rfind(b" ") + 1 :]
    return [("word", word[-8:], min(len(word), 255)) if order == mixlm.WORD else (order, (bytes(8) + line)[len(line) + 8 - order :]) for order in mixlm.ORDERS]


def test_counts_of_bits():
    """Each context's and node's bits, against a plain count."""
    from collections import Counter

    r = np.random.default_rng(6)
    text = np.frombuffer(bytes(r.choice(list(b"abc de"), 150).astype(np.uint8)), np.uint8)
    tree, bits = mixlm.Tree(follow(text)), [24] * mixlm.PREDICTORS
    found = mixlm.merged([mixlm.count_bits(tree, bits, text, np.array([0, len(text)]))])
    plain = Counter()
    for at, byte in enumerate(text.tolist()):
        before = int(text[at - 1]) if at else 0
        code, length = int(tree.code[before * 256 + byte]), int(tree.length[before * 256 + byte])
        for k, context in enumerate(contexts_of(text, at)):
            for depth in range(length):
                plain[k, context, depth, code & (1 << depth) - 1, code >> depth & 1] += 1
    assert sorted(plain.values()) == sorted((found & 0xFFFFFFFF).tolist())
    many = mixlm.merged([found] * 3)
    assert (many >> 32 == found >> 32).all() and (many & 0xFFFFFFFF == 3 * (found & 0xFFFFFFFF)).all()
    large = mixlm._entries(np.array([7, 9]), np.array([3, (5 << 32) + 4]))
    assert mixlm.np.bincount(large >> 32, large & 0xFFFFFFFF).astype(int)[[7, 9]].tolist() == [3, (5 << 32) + 4]


def test_nodes_of_a_position_are_neighbours():
    """A context's first nodes share a line of slots, and no two nodes of a tree share a slot of it."""
    r = np.random.default_rng(11)
    tree = mixlm.Tree(follow(r.integers(97, 123, 3000).astype(np.uint8)))
    first, node = tree.paths
    node &= np.uint32((1 << 31) - 1)
    for before in (97, 0):
        seen = {}
        for pair in range(before * 256, before * 256 + 256):
            n = int(tree.length[pair])
            path = node[first[pair] : first[pair] + n].tolist()
            assert all(0 < x < 32 for x in path[:5]) and len({x >> 5 for x in path[5:10]}) <= 1
            for depth, x in enumerate(path):
                assert seen.setdefault(x, (depth, int(tree.code[pair]) & (1 << depth) - 1)) == (depth, int(tree.code[pair]) & (1 << depth) - 1)


def test_trees_of_windows():
    """Windows against a plain reading; trees for frequent ones take fewer bits, and the chances of all next symbols add up to one."""
    r = np.random.default_rng(12)
    plain = bytes(r.choice(list(b"abcd "), 60000).astype(np.uint8)).replace(b"ab", b"abxyz") + b"\0"
    texts = [b"\0", b"q\0", plain, b"ab\0"]
    text, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    kind = lambda c: c - 96 if 97 <= c <= 122 else 27 if c == 32 else 0
    expected = [0 if i == 0 else kind((b" " + t)[i - 1]) << 8 | t[i - 1] for t in texts for i in range(len(t))]
    assert mixlm.windows(text, ends).tolist() == expected
    counts = np.bincount(mixlm.windows(text, ends).astype(int) * 256 + text, minlength=mixlm.WINDOWS << 8)
    tree, old = mixlm.Tree.of(counts), mixlm.Tree.of(np.bincount(mixlm.pairs_of(text, ends), minlength=1 << 16))
    assert len(tree.length) > len(old.length) == 1 << 16
    assert tree.length[tree.places(text, ends)].sum() < old.length[old.places(text, ends)].sum()
    assert (tree.which.reshape(-1, 256)[:, 32] == 32).all()
    model = mixlm.Model.start(tree, mixlm.tables_of([18] * mixlm.PREDICTORS, mixlm.count_bits(tree, [18] * mixlm.PREDICTORS, text, ends)))
    head = b"dabxy"
    tails = np.frombuffer(b"".join(head + bytes([s]) for s in range(256)), np.uint8)
    whole = mixlm.costs(model, tails, np.arange(257) * 6)
    first = mixlm.costs(model, np.frombuffer(head, np.uint8), np.array([0, 5]))
    assert abs(np.exp(-(whole - first)).sum() - 1) < 1e-3


def test_contexts_are_made_in_runs(monkeypatch):
    """Contexts take little memory beside their own, which is what their time went to; where runs begin doesn't matter."""
    import tracemalloc

    r = np.random.default_rng(10)
    many = np.append(r.integers(1, 30, 400), 1 << 20)
    ends = np.append(0, np.cumsum(many))
    text = r.choice(np.frombuffer(b"abc   ", np.uint8), int(ends[-1]))
    text[ends[1:] - 1] = 0
    tracemalloc.start()
    try:
        whole = mixlm.contexts(text, ends)
        assert tracemalloc.get_traced_memory()[1] < 24 * len(text)  # 4 bytes for each predictor, and a copy of the text
    finally:
        tracemalloc.stop()
    short, borders = text[: ends[-2]], ends[:-1]
    for run in (1, 5, 64):
        monkeypatch.setattr(mixlm, "RUN", run)
        assert all((a == b[: len(short)]).all() for a, b in zip(mixlm.contexts(short, borders), whole))
    alone = [mixlm.contexts(short[a:b], np.array([0, b - a])) for a, b in zip(borders[:60], borders[1:61])]
    assert all((np.concatenate(x) == y[: borders[60]]).all() for x, y in zip(zip(*alone), whole))


def test_counts_are_summed_in_steps(spark, monkeypatch):
    """Tables of parts that meet in several steps are those of one count; tuning documents can be taken out."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 60").select("text", (F.col("doc_id") % 10 == 0).alias("tuning")).repartition(6)
    rows = docs.toPandas()
    text, ends = mixlm.stream(pa.array(rows["text"].tolist()))
    counts = np.bincount(mixlm.pairs_of(text, ends), minlength=1 << 16)
    tree, bits = mixlm.Tree(counts.reshape(256, 256)), [16] * mixlm.PREDICTORS
    monkeypatch.setattr(mixlm, "ADDED", 2)
    monkeypatch.setattr(mixlm, "estimated_parts", lambda *_: 9)
    values, touched = mixlm.bit_values(docs, tree, bits)
    assert all((a == b).all() for a, b in zip(values, mixlm.tables_of(bits, mixlm.count_bits(tree, bits, text, ends))))
    rest = mixlm.tables_of(bits, mixlm.count_bits(tree, bits, *mixlm.stream(pa.array(rows["text"][~rows["tuning"]].tolist()))))
    for table, (at, less) in zip(values, touched):
        table[at] = less
    assert all((a == b).all() for a, b in zip(values, rest))


def test_starting_weights_are_of_all_training_documents(spark):
    """Every bit of every training document, long ones too, is counted once for the fit, and the weights are those of a plain fit."""
    import pyarrow as pa

    draw = np.random.default_rng(8)
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta", "of", "is"], 4000).tolist()) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    text, ends = mixlm.stream(pa.array(texts))
    pairs = mixlm.pairs_of(text, ends)
    model = mixlm.trained(docs, np.bincount(pairs, minlength=1 << 16))
    assert np.abs(model.weights - np.array(mixlm.START)).max() > 0.01
    cells = mixlm.bit_cells(docs, model)
    assert cells.sum() == model.tree.length[pairs].sum()
    plain, x = {}, list(model.walk(text, pairs, mixlm.contexts(text, ends)))
    for _, bit, values, gate in x:
        odds = np.stack(values) / mixlm.UNIT
        level = np.sign(odds) * sum(np.abs(odds) >= edge for edge in mixlm.EDGES)
        for key in zip(gate.tolist(), *level.astype(int).tolist(), bit.astype(int).tolist()):
            plain[key] = plain.get(key, 0) + 1
    assert sorted(plain.values()) == sorted(cells[cells > 0].tolist())


def test_stream_is_words_with_single_spaces():
    import pyarrow as pa

    texts = [None, "", " a  B\n", "x y", "\n", "é  z "]
    text, ends = mixlm.stream(pa.array(texts))
    assert [bytes(text[a:b]) for a, b in zip(ends, ends[1:])] == [b"\0", b"\0", b"a b\0", b"x y\0", b"\0", "é z\0".encode()]


def test_stream_against_a_plain_one():
    import re

    import pyarrow as pa

    r = np.random.default_rng(9)
    texts = ["".join(r.choice(list(" \t\nAbZé\x0b\x1f"), int(n)).tolist()) for n in r.integers(0, 9, 400)]
    text, ends = mixlm.stream(pa.array(texts))
    plain = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).encode().lower() + b"\0" for t in texts]
    assert [bytes(text[a:b]) for a, b in zip(ends, ends[1:])] == plain


def test_pairs_come_once(monkeypatch):
    """A context and the bytes around are held once however often they come, in more entries only where a count is too large for one."""
    text = np.frombuffer(b"ab " * 500, np.uint8)
    ends, bits = np.array([0, len(text)]), [18] * mixlm.PREDICTORS
    tree = mixlm.Tree(follow(text))
    assert len(mixlm.count_pairs(bits, text, ends)) < 50
    whole = mixlm.merged([mixlm.count_bits(tree, bits, text, ends)])
    monkeypatch.setattr(mixlm, "TIMES_BITS", 3)
    assert len(mixlm.count_pairs(bits, text, ends)) > 500
    assert mixlm.merged([mixlm.count_bits(tree, bits, text, ends)]).tolist() == whole.tolist()


def test_bits_of_pairs_take_little_memory():
    """Bits of counted pairs are made and added up in steps: about what they and the result take, and no copies of all."""
    import tracemalloc

    text = np.random.default_rng(13).integers(97, 123, 300_000).astype(np.uint8)
    tree, bits, ends = mixlm.Tree(follow(text)), [22] * mixlm.PREDICTORS, np.array([0, len(text)])
    pairs = mixlm.merged([mixlm.count_pairs(bits, text, ends, tree)], mixlm.TIMES_BITS)
    tracemalloc.start()
    try:
        many = 0
        for found in mixlm.bits_of(tree, bits, pairs):
            many = max(many, len(found))
            mixlm.merged([found])
            del found
        assert tracemalloc.get_traced_memory()[1] < 8 * many * 3 + (8 << 20)
    finally:
        tracemalloc.stop()


def test_scores_write_few_files(spark):
    """Hadoop's local file system starts programs for each file, and an executor's JVM is there twice while one begins: files follow the size of rows, not the tasks."""
    import os

    from keystrata.llm.common import cut

    assert cut(spark.range(0, 500, 1, 40), by="id").count() == 500
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    files = lambda: sum(f.startswith("part-") for _, _, names in os.walk(where) for f in names)
    before = files()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("doc_id < 120").repartition(40)
    assert mixlm.score_documents(docs).count() == docs.count()
    assert 0 < files() - before <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_near_duplicate_recall(spark):
    """All links of the given documents, by an inverted index of shingles."""
    from collections import Counter, defaultdict

    from tests.llm.fixtures import words

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sets, where = {}, defaultdict(list)
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        w = words(r["text"], True)
        sets[r["doc_id"]] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for g in sets[r["doc_id"]]:
            where[g].append(r["doc_id"])
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    links = 0
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= 75 * len(s | sets[j]):
                links += 1
                assert found[i] == found[j]
    assert links > 50


def template_rows(docs=400, seed=1):
    """Copies of a template of which most pairs have a similarity just under the threshold, and a further copy of each that reaches it with that one only."""
    r = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(docs):
        slots = r.permutation(38)[:8]
        for more in (3, 8):
            own = list(base)
            for k in slots[:more]:
                own[2 + 5 * k] = f"e{i}x{k}"
            rows.append((len(rows), " ".join(own), "en", "s", 1))
    return rows


def test_near_duplicates_within_a_template(spark):
    """Components of one dense region, against all pairs."""
    from tests.llm.fixtures import frame, words

    rows = template_rows()
    sets = []
    for _, text, *_ in rows:
        w = words(text, True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert [found[i] for i in range(len(rows))] == root


def test_all_bits_refine_the_weights():
    """Costs against a plain version whose weights and corrections follow every bit of a block."""
    r = np.random.default_rng(5)
    draw = lambda n: r.choice(np.array([32, *range(97, 121)]), n, p=np.arange(25, 0, -1) / 325).astype(np.uint8)
    model, text = learned(draw(4000)), draw(900)
    ends = np.array([0, 900])
    hashed, pairs = mixlm.contexts(text, ends), mixlm.pairs_of(text, ends)
    own, total, at, block = np.zeros(mixlm.PREDICTORS), 0.0, 0, mixlm.FIRST_BLOCK
    add, surety = np.zeros(mixlm.BUCKETS), np.full(mixlm.BUCKETS, mixlm.MAP_PULL)
    while at < 900:
        change, bits = np.zeros(mixlm.PREDICTORS), 0
        off, curves = np.zeros(mixlm.BUCKETS), np.zeros(mixlm.BUCKETS)
        for i in range(at, min(900, at + block)):
            for _, bit, x, gate in model.walk(text[i : i + 1], pairs[i : i + 1], [h[i : i + 1] for h in hashed]):
                x, bit = np.array([v[0] for v in x]) / mixlm.UNIT, int(bit[0])
                odds = (x * (model.weights[gate[0]] + own)).sum()
                b = int(mixlm.bucket_of(np.array([odds], np.float32))[0])
                p = 1 / (1 + np.exp(-odds - add[b]))
                total -= np.log(p if bit else 1 - p)
                change, bits = change + x * (bit - p), bits + 1
                off[b] += bit - p
                curves[b] += mixlm._CURVE[b]
        own = own + mixlm.RATE * change / np.sqrt(bits + 16)
        surety += curves
        add += off / surety
        at, block = at + block, block * 2
    assert abs(mixlm.costs(model, text, ends)[0] / total - 1) < 1e-4
