"""Prefix trie, spelling groups and SentencePiece against brute force: hot groups, nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltmark.llm import pieces, prefixtrie, queries, spelling

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- prefix trie


def conversations_of(rows):
    out = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuilt_of(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes_of(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += k not in children
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    rows = []
    for c in range(-25, 90):
        n = rng.choice([1, 1, 2, 3, 5])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "a", "c d  e", ""])))
    # one conversation holds a third of all turns, and one of its copies as many
    rows += [(c, t, "user", f"w{t % 7} x") for c in (500, 501) for t in range(150)]
    # copies of one conversation
    rows += [(c, t, "user", "hello you") for c in range(600, 700) for t in range(2)]
    rows += [(900, None, None, None), (900, 0, "user", None), (901, 1, "user", "z"), (901, 1, "bot", "z"), (902, 0, "u", "same"), (902, 0, "u", "same"), (None, 0, "user", "x")]
    rng.shuffle(rows)
    return rows


def test_trie_holds_every_beginning(spark, turns):
    df = spark.createDataFrame(turns, TURNS).repartition(7)
    assert collected(prefixtrie.prefix_trie(df), NODE) == nodes_of(conversations_of(turns))


def test_trie_of_rebuilt_conversations(spark, turns):
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    assert collected(prefixtrie.rebuilt(df), NODE) == nodes_of(rebuilt_of(conversations_of(turns)))


def test_trie_carries_on_over_many_partitions(spark, turns, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    monkeypatch.setattr(prefixtrie, "FAN", 2)
    monkeypatch.setattr(prefixtrie, "PIECE", 24)
    try:
        df = spark.createDataFrame(turns, TURNS)
        rows = prefixtrie.hashed_turns(df).persist()
        _, carry = prefixtrie.placed(rows, ["o1", "o2", "ta", "tb"])
        assert carry and any(v[3] for v in carry.values())
        assert collected(prefixtrie.prefix_trie(df), NODE) == nodes_of(conversations_of(turns))
        got = {(r["conv"], r["at"]) for r in prefixtrie.numbered(rows).collect()}
        assert got == {(c, k) for c, t in conversations_of(turns).items() for k in range(len(t))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_names_nodes_and_takes_other_columns(spark):
    rows = [(1, 0, "u", "a", 9), (1, 1, "u", "b", 9), (2, 0, "u", "a", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").withColumn("n_convs", F.lit("x"))
    got = {r["node"]: r for r in prefixtrie.prefix_trie(df).collect()}
    assert len(got) == 3
    assert sorted(r["depth"] for r in got.values()) == [0, 1, 2]
    for r in got.values():
        assert r["parent"] is None if r["depth"] == 0 else got[r["parent"]]["depth"] == r["depth"] - 1
    assert prefixtrie.prefix_trie(df.limit(0)).count() == 0
    assert prefixtrie.rebuilt(df.limit(0)).count() == 0


def test_turnless_conversation_is_at_the_root(spark):
    # 23 takes from 20, which isn't there, and has fewer turns than it gives up
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "a"), (40, 0, "u", "b")]
    assert collected(prefixtrie.rebuilt(spark.createDataFrame(rows, TURNS)), NODE) == nodes_of(rebuilt_of(conversations_of(rows)))


# --- spelling


def brute_groups(n):
    def near(x, y):
        if len(x) > len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    form, count = {}, {}
    for w in n:
        of = [o for o in n if near(w, o)]
        count[w] = len(of)
        best = min(of, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


GROUP = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(8)
    n = {}
    for _ in range(150):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(5, 9)))
        n[w] = rng.randint(3, 400)
        for _ in range(rng.choice([0, 1, 3])):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + "c" + w[k:], w[:k] + "d" + w[k + 1 :], w[: k + 1] + w[k:]])
            if len(v) >= 5:
                n.setdefault(v, rng.randint(3, 40))
    # a third of all words have the same first half
    n |= {"common" + "".join(rng.choice("xyz") for _ in range(6)): rng.randint(3, 99) for _ in range(120)}
    # a chain of forms
    n |= {"q" * k + "rstuv": 3 * 2**k for k in range(7)}
    return n


@pytest.mark.parametrize("shard,part", [(1 << 16, 1 << 16), (50, 16)])
def test_groups_are_those_of_all_pairs(spark, vocabulary, shard, part):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    assert collected(spelling.spelling_groups(df, shard=shard, part=part), GROUP) == brute_groups(vocabulary)


def test_a_half_of_many_words_is_divided(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_BROADCAST", 0)
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    assert collected(spelling.spelling_groups(df, shard=30, part=8), GROUP) == brute_groups(vocabulary)


def test_groups_of_rows_that_repeat_and_are_null(spark):
    rows = [("hello", 3), ("hello", 4), (None, 5), ("hallo", 20), ("aaaaa", 3), ("aaaa", 9), ("", 2)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit(1)).withColumn("kind", F.lit("x"))
    assert collected(spelling.spelling_groups(df), GROUP) == brute_groups({"hello": 7, "hallo": 20, "aaaaa": 3, "aaaa": 9, "": 2})
    assert spelling.spelling_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(df, times=1)


def test_op12_counts_words_of_documents(spark, tmp_path):
    rng = random.Random(4)
    words = ["Größe", "größe", "grösse", "Éclair", "abcde", "abcdf", "xy", "longerword", "longerwords"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + rng.choice(["", "\n1a2b", "×÷"])) for i in range(60)] + [(None, "abcde " * 5), (3, None), (4, ""), (5, "abcde"), (5, "abcde")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    expected = brute_groups({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})
    assert collected(queries.op12_spelling(spark, str(tmp_path)), GROUP) == expected


# --- pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return pieces.Model.read(str(public_tokenizers.path("piece_bpe_32k.model")))


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "a▁b", "▁", "▁▁x", "\n", "a\nb c\n\n d", "\t x\r\n", "\x00y", "<s> x </s>", "<0x41>", "<unk>", "É ça où", "日本語のテキスト", "🙂 ½ a b",
    "　x", "the " * 5000, "x" * 30000, " " * 3000, "word" + " " * 50 + "word",
]


def test_ids_and_texts_are_the_librarys(spark, model):
    sp = model.processor()
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é▁ \n日🙂") for _ in range(rng.randint(0, 60))) for _ in range(300)] + TEXTS
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, ids string").withColumn("decoded", F.lit(1)).repartition(3)
    got = pieces.decode(pieces.encode(df, model), model).collect()
    assert len(got) == len(texts) and got[0].__fields__ == ["doc_id", "text", "ids", "decoded"]
    for r in got:
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids)


def test_slices_and_small_tables_give_the_same(spark, model, monkeypatch):
    sp = model.processor()
    monkeypatch.setattr(pieces, "SLICE", 7)
    for text in TEXTS:
        assert [s for part in pieces.stretches(text or "") for s in part] == re.findall(" +[^ ]*", " " + text.replace("▁", " ")) if text else True
    table = pieces._Table(sp, 2)
    for text in TEXTS:
        got = b"".join(b"".join(map(table.__getitem__, part)) for part in pieces.stretches(text or ""))
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == sp.encode(text or "")
    assert len(table) <= 2


def test_the_table_is_bounded_and_only_saves_work(spark, model, monkeypatch):
    df = spark.createDataFrame([(k, f"often w{k % 40} once{k}") for k in range(200)], "doc_id long, text string")
    monkeypatch.setattr(pieces, "TABLE_ROWS", 3)
    monkeypatch.setattr(pieces, "COUNT_LEAST", 1)
    table = pieces.chunk_table(df, model)
    assert set(table) == {" often"}
    one, other = (sorted((r["doc_id"], r["ids"]) for r in pieces.encode(df, model, table=t).collect()) for t in (table, {}))
    assert one == other
    assert pieces.chunk_table(df.limit(0), model) == {} and pieces.encode(df.limit(0), model).count() == 0


def test_decoding_ids_that_are_no_text(spark, model):
    sp = model.processor()
    rows = [[], None, [1, 264, 2], [0, 264], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [264, 28705, 264], [28705], [2]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, ids array<int>")
    for r in pieces.decode(df, model).collect():
        assert r["decoded"] == sp.decode(rows[r["k"]] or [])


def test_op13_digests(spark, tmp_path, model):
    sp = model.processor()
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_pieces(spark, str(tmp_path)).collect():
        ids = sp.encode(TEXTS[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
