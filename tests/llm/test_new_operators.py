"""Vector codes, conversation trie and best-fit packing against plain computations."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bestfit, bytebpe, codes, queries, trie

MID = "/root/testdata/sf0.01"


def plain_trie(rows, group=100, heads=6):
    """Nodes by definition, from rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - int(np.fmod(c, group)), [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    saved, leaves = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        saved[key] = ((len(nodes[key]) - 1) * len(key[-1][1]) if key else 0) + sum(saved[k] for k in kids[key])
        leaves[key] = sum(leaves[k] for k in kids[key]) if kids[key] else 1
    out = {}
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out[min(members), len(key)] = (parent, len(members), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


TALKS = "conv_id long, turn long, role string, text string"


def talks():
    """Conversations with copies, shared starts, ends inside others, long ones, gaps, nulls and repeated turns."""
    rng = np.random.default_rng(5)
    rows = []
    for c in [*range(-3, 40), *range(100, 140), 205, 317, 901]:
        n = int(rng.integers(1, 9))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}-{int(rng.integers(0, 2))}" * int(rng.integers(1, 2))) for t in range(n)]
    for c in range(1000, 1030):  # copies, and one that goes on
        rows += [(c, t, "user", f"same {t}") for t in range(12 + (c == 1007))]
    rows += [(2000 + k, t, "user", f"long {t}") for k in range(3) for t in range(25 + k)]
    rows += [(300, None, "user", "first"), (300, 0, None, "x"), (300, 0, "a", None), (300, 0, "a", None), (None, 1, "user", "nobody"), (301, 5, "", "é𝄞"), (301, 5, "", "é𝄞")]
    return rows


@pytest.mark.parametrize(("block", "local"), [(512, 4096), (16, 6)])
def test_trie_equals_plain_trie(spark, block, local):
    df = spark.createDataFrame(talks(), TALKS).withColumn("code", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("bucket", F.lit("b"))
    assert as_nodes(trie.prefix_trie(df, block=block, local=local)) == plain_trie(talks())


def test_trie_of_the_table(spark):
    rows = pd.read_parquet(f"{MID}/conversations.parquet")
    got = as_nodes(queries.QUERIES["op12_trie"](spark, MID))
    assert got == plain_trie(rows[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))


def test_trie_of_few_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALKS)).count() == 0
    only = [(7, 0, "user", "x")]
    assert as_nodes(trie.prefix_trie(spark.createDataFrame(only, TALKS))) == plain_trie(only)
    nobody = [(None, 0, "user", "x")]
    assert trie.prefix_trie(spark.createDataFrame(nobody, TALKS)).count() == 0


def test_long_conversations_are_numbered_over_tasks(spark):
    rows = [(5, t, "user", f"{t}") for t in range(3000)] + [(4, 0, "a", "x"), (6, 0, "a", "y"), (6, 1, "a", "z")]
    got = trie.numbered_turns(spark.createDataFrame(rows, TALKS).repartition(7)).collect()
    assert sorted((r.conv_id, r.pos) for r in got) == sorted((c, t) for c, t, _, _ in rows)


# --- Vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(codes by row, errors by row, codebooks) from rows (vec_id, vector) in order of id."""
    v = [[int(np.floor(1024.0 * x)) for x in e] for _, e in rows]
    w = len(v[0]) // parts
    cut = [[r[p * w : (p + 1) * w] for p in range(parts)] for r in v]
    books = [[list(r[p]) for r in cut[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for r in cut:
                of[near(r[p], books[p])[0]].append(r[p])
            for e, members in of.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = [[near(r[p], books[p]) for p in range(parts)] for r in cut]
    return ["".join(f"{i:02x}" for i, _ in f) for f in found], [sum(d for _, d in f) for f in found], books


def test_codes_equal_plain_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * (0.01 if i % 7 == 0 else 1)], None if i % 3 == 0 else int(i % 3)) for i in rng.permutation(400)]
    rows[5] = (rows[5][0], rows[6][1], rows[5][2])  # equal vectors
    odd = [(9000, None, 1), (9001, [None] * 8, 1), (9002, [float("nan")] * 8, 1), (9003, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).withColumn("v", F.lit(1)).withColumn("error", F.lit("x"))
    got = {r.vec_id: r for r in codes.compress(df.repartition(5)).collect()}
    ordered = sorted(rows)
    want, errors, books = plain_codes([r[:2] for r in ordered])
    by_label = collections.Counter()
    for r, e in zip(ordered, errors):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for r, c, e in zip(ordered, want, errors):
        assert (got[r[0]].code, got[r[0]].error, got[r[0]].label_error, got[r[0]].codebooks_sha256) == (c, e, by_label[r[2]], digest)


def test_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{MID}/embeddings.parquet')")
    want = con.execute(queries.ORACLE_SQL["op11_codes"]).df()
    got = queries.QUERIES["op11_codes"](spark, MID).toPandas()[list(want.columns)]
    assert (got.sort_values("vec_id").values == want.sort_values("vec_id").values).all()


def test_nearest_entries_with_ties_and_big_numbers():
    rng = np.random.default_rng(4)
    for big in (1, 2**20, 2**26):
        v, book = rng.integers(-3, 4, (300, 16)) * big, rng.integers(-3, 4, (64, 16)) * big
        book[9] = book[40]
        index, error = codes.nearest_entries(v, book)
        d = ((v[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    few = codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [], None), (None, [1.0], 1), (2, [1e300, -1e300], 2)], kind)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in few if r.vec_id) == [(False, 1, "01000000", 0)] or len(few) == 4
    assert all(r.error == 0 for r in few)
    books = codes.fit(spark.createDataFrame([(1, [0.5, 0.25, -0.5, 1.0], 1)], kind))
    back = codes.decode(codes.encode(spark.createDataFrame([(1, [0.5, 0.25, -0.5, 1.0], 1)], kind), books), books).first()
    assert list(back.vector) == [0.5, 0.25, -0.5, 1.0]


# --- Best-fit packing


def check_packing(rows, texts, seq_len, tokenizer, ends=0):
    for doc_id, parts in rows.sort_values("piece").groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, ends]
        assert list(parts.piece) == list(range(len(parts))) and list(parts.start) == [0, *parts.length.cumsum()[:-1]]
        assert [i for p in parts.ids for i in p] == ids and parts.length.sum() == len(ids)
        assert (parts.length.iloc[1:] == seq_len).all() and parts.length.iloc[0] == (len(ids) - 1) % seq_len + 1
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(parts.ids, parts.ids_crc32))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= seq_len


def best_fit_decreasing(lengths, seq_len):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(seq_len - n)
        else:
            room[room.index(fit)] -= n
    return len(room)


@pytest.mark.parametrize(("seq_len", "range_runs"), [(2048, 512), (64, 8)])
def test_best_fit_round_trip(spark, sf, seq_len, range_runs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.byte_tokenizer_path())
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    odd = ["hello <|endoftext|> world", "", None, "a  b\n\n c\t\td ²x½ a_b __  ", "中文 text \x85", "“q” – x… don't I'LL", " ", "\r\n 1234.56"]
    texts = {int(i): t for i, t in zip(docs.doc_id, docs.text)} | {10_000 + k: t for k, t in enumerate(odd)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("piece", F.lit("x")).withColumn("length", F.lit("x")).repartition(6)
    rows = bestfit.pack(frame, queries.byte_tokenizer_path(), seq_len, keep_ids=True, range_runs=range_runs).toPandas()
    assert set(rows.doc_id) == set(texts)
    check_packing(rows, texts, seq_len, tokenizer)
    assert rows.sequence_id.nunique() <= 1.01 * best_fit_decreasing(rows.length.tolist(), seq_len) + 1


def test_matches_place_every_piece_once(spark):
    rng = np.random.default_rng(6)
    for lengths in (rng.integers(1, 257, 3000), rng.integers(1, 4, 5000), np.full(500, 90), rng.integers(70, 110, 2000), np.array([256, 256, 1])):
        counts = dict(collections.Counter(lengths.tolist()))
        placed, used = set(), collections.defaultdict(list)
        matches = bestfit.match_all(spark, counts, 256, range_runs=64)
        for size, first, n, seq, per, offset in matches:
            for k in range(n):
                assert (size, first + k) not in placed
                placed.add((size, first + k))
                used[seq + k // per].append((offset + k % per * size, size))
        assert placed == {(s, k) for s, n in counts.items() for k in range(n)}
        for pieces in used.values():
            at = 0
            for offset, size in sorted(pieces):
                assert offset == at
                at += size
            assert at <= 256
        assert len(used) <= 1.03 * best_fit_decreasing(lengths.tolist(), 256) + 1


def test_best_fit_of_odd_rows(spark):
    kind = "doc_id long, text string"
    path = queries.byte_tokenizer_path()
    assert bestfit.pack(spark.createDataFrame([], kind), path).count() == 0
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, ""), (2, "word " * 5000)]
    got = bestfit.pack(spark.createDataFrame(rows, kind), path, keep_ids=True).collect()
    assert sorted((r.length, r.doc_id or 0) for r in got if r.doc_id != 2) == [(1, 1), (1, 1), (3, 0), (3, 0)]
    assert [r.length for r in sorted((r for r in got if r.doc_id == 2), key=lambda r: r.piece)][1:] == [2048, 2048]


def test_byte_encoder_equals_tokenizer(sf):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(queries.byte_tokenizer_path()), bytebpe.encoder(queries.byte_tokenizer_path())
    texts = [*pd.read_parquet(f"{sf}/documents.parquet").text, "x" * 5000, "²³½ 12½a a½ ª ­x", "'s's 'LL it's_ _'t", "\t\t\n  x\n", "é­ Ā ſ İ", "<|endoftext|><|ENDOFTEXT|>", "a b"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
