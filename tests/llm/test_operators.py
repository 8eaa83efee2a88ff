"""Every operator against a brute-force version on the test tables, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estate_spark.llm import (chat, components, decontaminate, lines, lm, neardup, pieces, quality, records,
                              sharding, text, toxicity)
from estate_spark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = ("gamma " * 3 + "delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau ") * 40
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s"), (2, None, "en", "s"), (3, "", None, None),
    (4, "alpha beta gamma delta epsilon zeta eta theta", "en", "s"), (4, "alpha beta gamma delta epsilon zeta eta theta", "en", "s"),
    (None, "one\n\n \none\nTwo words", "de", "s"), (5, LONG, "en", "s"), (6, LONG + "end", "en", "t"), (7, " \n\t ", "en", "s"),
    (8, "ß " * 70 + "日本語 \U0001F600 x", "xx", "s"), (9, "Eins", "de", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return WORD.findall(lower(t or ""))


def stored(spark, tmp_path, rows, schema=SCHEMA):
    """A scan of files with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df = df.withColumns({c: F.lit("mine") for c in ("row", "_row", "_doc", "k", "key", "bands", "ids", "_key", "_dropped", "set_id", "n_words")})
    path = f"{tmp_path}/docs-{len(rows)}"
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def awkward(spark, tmp_path):
    return stored(spark, tmp_path, AWKWARD)


@pytest.fixture
def empty(spark, tmp_path):
    return stored(spark, tmp_path, [])


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def by_id(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


# ------------------------------------------------------------- 1 chat formatting
def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")


def test_chat_round_trip_of_control_strings(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "[\\INST]", "[/OUT]</s>\n[OUT] x", "<", "<s", "[", "", "a\nb [/END]\n"]
    rows = [(1, i, role, t, None) for i, (role, t) in enumerate((r, t) for t in hard for r in ("user", "assistant", "tool", "[INST]", None))]
    rows += [(2, 0, "user", None, None), (2, 1, "assistant", "x", None)]
    out = chat.format_conversations(conversations(spark, rows)).withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))}).collect()
    got = {r["conv_id"]: r for r in out}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t) for _, _, r, t, _ in rows[:-2]]
    assert got[1]["loss"] == "".join(hard)
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("user", ""), ("assistant", "x")] and got[2]["valid"]
    joined = "".join(s["text"] for s in got[1]["segments"])
    assert joined == got[1]["formatted"]


@pytest.mark.parametrize("roles,valid,error", [
    (["system", "user", "assistant"], True, None), (["user", "assistant", "user", "assistant"], True, None),
    (["user", "user", "assistant"], False, 2), (["assistant"], False, 1), (["user"], False, None), (["user", "system"], False, 2)])
def test_turn_order(spark, roles, valid, error):
    r = chat.format_conversations(conversations(spark, [(7, i, x, "t", None) for i, x in enumerate(roles)])).first()
    assert (r["valid"], r["first_error"], r["n_turns"]) == (valid, error, len(roles))


def test_chat_empty_and_ties(spark):
    assert chat.format_conversations(conversations(spark, [])).count() == 0
    same = [(None, None, "user", "a", None)] * 2
    assert chat.format_conversations(conversations(spark, same)).first()["n_turns"] == 2


# ------------------------------------------------------------- 2 toxicity
def test_toxicity_on_held_out_rows(spark, sf):
    rows = by_id(spark, sf, "op2_toxicity")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    clean = [r for i, r in rows.items() if labels.get(i) == 0]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


def group_sentences():
    """Toxic sentences that mention one group too often, so that a plain fit learns the group."""
    rows = []
    for i in range(200):
        rows.append((f"these {'muslims' if i % 10 < 8 else 'people'} are awful stupid filler{i % 17}", 1))
        rows.append((f"these {'muslims' if i % 10 < 2 else 'people'} are lovely clever filler{i % 13}", 0))
        rows.append((f"{['christians', 'jews', 'atheists'][i % 3]} met today filler{i % 19}", 0))
    return rows


def test_counterfactuals_lower_the_weight_of_groups(spark):
    sample = spark.createDataFrame(group_sentences(), "text string, toxic int")
    plain, paired = toxicity.fit(sample, pairing=0.0), toxicity.fit(sample, pairing=2.0)

    def gap(model):
        a, b = toxicity.scores(["muslims met here", "christians met here"], model)
        return abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))
    assert gap(paired) < 0.25 * gap(plain)
    assert toxicity.scores(["they are stupid awful"], paired)[0] > 0.5 > toxicity.scores(["muslims met today"], paired)[0]


def test_swapped_terms():
    assert toxicity.swapped("Women and the old man") == "Men and the young woman"
    assert toxicity.swapped("nobody here") != "nobody here"


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (77, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(awkward, labels, F.lit(True)))
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 4)}) == 1
    none = toxicity.fit(toxicity.labelled_sample(empty, labels, F.lit(True)))
    assert toxicity.score(awkward, none).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    only = toxicity.labelled_sample(awkward, spark.createDataFrame([(4, 1)], "doc_id long, toxic int"), F.lit(True))
    assert only.count() == 1


# ------------------------------------------------------------- 3 token records
def test_records_equal_the_library(spark, sf, texts):
    from tokenizers import Tokenizer
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = by_id(spark, sf, "op3_token_records")
    for i in sorted(texts):
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_pieces_of_white_space_kinds():
    enc = records.encoder(public_tokenizers.path("word_bpe_49k.json"))
    cases = ["a b c\td\x1ce", "it's  'S x'll", "é ́x", "", "  ", "A\r\n\x0bB C", "<|endoftext|> <|startoftext|>x",
             "a<|EndOfText|>b", "Word,word (WORD).--'s x,'s It's, e\u0301. H\u0331H, h\u0331 ,\u0301a.\u0338b <|end", "ÜBER, über. ÷, ×.a Ø.b,»c",
             "1,2.5 a1.b2 _x.", "don't.Won'T,o'LL-d", "W" * 5000 + "," + "ß" * 50]
    for t, ids in zip(cases, enc.encode(cases)):
        assert np.frombuffer(ids, enc.width).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aEzH sStTlL','\".,-!;:()<|>_09\n\t\u0301\u0331\u0338éÉ×»ßİΣжЖ漢"), max_size=40), max_size=4))
def test_pieces_of_any_texts(cases):
    enc = records.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t, ids in zip(cases, enc.encode(cases)):
        assert np.frombuffer(ids, enc.width).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_records_awkward(spark, awkward, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = records.write_records(awkward, path, 1, str(tmp_path / "rec"), files=3)
    rows = records.read_records(files, str(tmp_path / "rec")).orderBy("start").collect()
    keys = [r["key"] for r in rows]
    assert keys == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9] and rows[2]["n_tokens"] == 1
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()
    none = records.write_records(empty, path, 1, str(tmp_path / "none"))
    assert records.read_records(none, str(tmp_path / "none")).count() == 0


def test_damage_is_seen(tmp_path):
    data = bytearray(records.frame(b"payload") + records.frame(b"next"))
    path = tmp_path / "x"
    path.write_bytes(data)
    with open(path, "rb") as f:
        first, at = records.unframe(f, 0)
        assert first == b"payload" and records.unframe(f, at)[0] == b"next"
    data[14] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(ValueError):
        records.unframe(f, 0)


# ------------------------------------------------------------- 4 decontamination
def hits_of(t, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    hit, own = set(), set()
    for item, it in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(it or ""))
        n = min(window, len(v))
        for k in range(max(1, len(v) - window + 1)) if v else ():
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[k:k + n]:
                    hit |= set(range(i, i + n))
                    own.add(str(item))
    return len(w), len(hit), sorted(own)


ITEMS = [("a", "gamma delta"), ("b", "Alpha, beta gamma delta epsilon zeta eta theta iota KAPPA lambda"), ("c", None), ("d", "..."),
         ("e", "ß"), ("a", "gamma delta"), ("f", "x y z q w e r t y u i o p"), ("g", "kappa lambda mu nu xi omicron pi rho sigma tau gamma gamma")]


@pytest.mark.parametrize("block", [50_000, 2])
def test_decontamination_awkward(spark, awkward, empty, block):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    rows = decontaminate.matches(awkward, items, block=block).collect()
    want = collections.Counter((d, *map(str, hits_of(t, ITEMS))) for d, t, _, _ in AWKWARD)
    assert collections.Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in rows) == want
    assert decontaminate.matches(empty, items, block=block).count() == 0
    left = decontaminate.drop(awkward, items, block=block)
    assert left.columns == awkward.columns and left.filter("_row <> 'mine'").count() == 0
    assert left.count() == sum(not hits_of(t, ITEMS)[1] for _, t, _, _ in AWKWARD)
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.drop(awkward, none).count() == len(AWKWARD)


def test_spans_point_into_the_original(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "é… GAMMA--Delta! gamma, DELTA; x", "en", "s")])
    items = spark.createDataFrame([("a", "gamma delta")], "item_id string, text string")
    r = decontaminate.matches(docs, items).first()
    t = "é… GAMMA--Delta! gamma, DELTA; x"
    assert [t[s["start"]:s["stop"]] for s in r["spans"]] == ["GAMMA--Delta! gamma, DELTA"]


# ------------------------------------------------------------- 5 SentencePiece
def scanned(m, t, chunk):
    parts = pieces.cut(t, chunk, 2 * m.longest)
    chunks = [pieces.Chunk(m, a, b, c, i == 0, i == len(parts) - 1) for i, (a, b, c) in enumerate(parts)]
    return sum((c.trace(*p) for c, p in zip(chunks, pieces.border_states([c.matrix() for c in chunks]))), [])


def test_parallel_scan_equals_the_library(texts):
    m = pieces.pieces(MODEL)
    rng = np.random.default_rng(3)
    cases = ["".join(rng.choice(list(a), 500)) for a in ("abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab ", "日本語の文章 ")]
    cases += [" " * 333, "a" * 500, "the" * 200, "=" * 400, "x\n" * 200, "".join(list(texts.values())[7].split())[:900]]
    cases += [t for t in texts.values() if 300 < len(t) < 3000][:20]
    for t in cases:
        for chunk in (60, 217):
            assert scanned(m, t, chunk) == m.sp.encode(t), (chunk, t[:40])


def test_max_plus_products_associate():
    rng = np.random.default_rng(1)
    ms = [rng.normal(size=s) for s in ((1, 3), (3, 5), (5, 2), (2, 4), (4, 1))]
    left = ms[0]
    for m, got in zip(ms[1:], pieces.prefix_products(ms)[1:]):
        left = pieces.product(left, m)
        assert np.allclose(left, got)


@pytest.mark.parametrize("chunk", [250, 40_000])
def test_pieces_awkward(spark, awkward, empty, chunk):
    rows = pieces.decode(pieces.encode(awkward, MODEL, chunk), MODEL).collect()
    sp = pieces.pieces(MODEL).sp
    want = collections.Counter((d, tuple(sp.encode(t or "")), t or "") for d, t, _, _ in AWKWARD)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert pieces.encode(empty, MODEL, chunk).count() == 0


# ------------------------------------------------------------- 6 line dedup
def shingles(x):
    x = x.lower()
    return frozenset(x[i:i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1)))


def line_classes(docs):
    """Positions that go, by exact comparison of all lines that share a shingle."""
    occ = collections.defaultdict(list)
    for n, t in enumerate(docs):
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"[^ \t\r\x0b\x0c]", x):
                occ[x].append((n, p))
    all_ = list(occ)
    sets = [shingles(x) for x in all_]
    near, root = collections.defaultdict(list), list(range(len(all_)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j in {j for g in s for j in near[g]}:
            both = len(s & sets[j])
            if both >= lines.THRESHOLD * (len(s) + len(sets[j]) - both) - 1e-12:
                root[find(i)] = find(j)
        for g in s:
            near[g].append(i)
    classes, gone = collections.defaultdict(list), collections.defaultdict(list)
    for i, x in enumerate(all_):
        classes[find(i)] += occ[x]
    for at in classes.values():
        for n, p in sorted(at)[1:]:
            gone[n].append(p)
    return {n: sorted(p) for n, p in gone.items()}


_COMMON = " ".join(f"{w}{i}" for i in range(5) for w in "the quick brown fox jumps over lazy dogs and runs away".split())
NEAR_LINES = [f"{_COMMON} {x}" for x in ("today", "now", "here", "tomorrow")]


def test_lines_awkward(spark, empty, tmp_path):
    rows = [*AWKWARD, *[(20 + i, f"head {i}\n{x}", "en", "s") for i, x in enumerate(NEAR_LINES)], (30, NEAR_LINES[0] + "\n \n" + NEAR_LINES[0], "en", "s")]
    docs = stored(spark, tmp_path / "more", rows)
    want = line_classes([t for _, t, _, _ in rows])
    got = lines.report(docs).collect()
    assert sorted((r["n_dropped"], r["dropped"]) for r in got) == sorted((len(want.get(n, [])), want.get(n, [])) for n in range(len(rows)))
    left = lines.drop_lines(docs)
    assert left.columns == docs.columns and left.count() == len(rows) and left.filter("_row <> 'mine'").count() == 0
    assert left.filter("doc_id = 30").first()["text"] == " " and left.filter("text is null").count() == 1
    assert lines.drop_lines(docs, keep_emptied=False).filter("doc_id = 30").count() == 0
    assert lines.drop_lines(empty).count() == 0 and lines.report(empty).count() == 0


def test_lines_of_the_test_table(spark, sf, texts):
    order = {r["doc_id"]: r["row"] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "monotonically_increasing_id() AS row").collect()}
    ids = sorted(texts, key=order.get)
    want = line_classes([texts[i] for i in ids])
    got = by_id(spark, sf, "op6_line_dedup")
    assert all(len(got[i]["dropped"]) == got[i]["n_dropped"] for i in ids)
    gone = {(n, p) for n, at in want.items() for p in at}
    found = {(n, p) for n, i in enumerate(ids) for p in got[i]["dropped"]}
    assert len(gone ^ found) <= 0.005 * len(gone)          # bands miss a few links near the threshold


UNBROKEN = [
    "https://example.org/a", "https://other.net/zzz", "Zusammenfassung", "Zusammenarbeit", "Zusammenarbeit", "abc", "ABC", "abd", "\u3042",
    "\u3053\u308c\u306f\u9577\u3044\u6587\u3067\u3059\u3001\u6700\u521d\u306f\u540c\u3058\u3067\u3059", "\u3053\u308c\u306f\u9577\u3044\u6587\u3067\u3059\u304c\u3001\u7d42\u308f\u308a\u306f\u5225\u3067\u3059",
    "column\tone\ttwo\t17", "column\tone\tsix\t99", "x" * 30 + "y", "x" * 40, "\U0001F600" * 9 + "ab", "\U0001F600" * 9 + "cd",
    "https://example.org/" + "abcdefghijklmnopqrstuvwxyz0123456789" * 2, "https://example.org/" + "abcdefghijklmnopqrstuvwxyz0123456789" * 2 + "0"]


def test_unbroken_lines(spark, tmp_path):
    rows = [(i, x, "en", "s") for i, x in enumerate(UNBROKEN)]
    docs = stored(spark, tmp_path, rows)
    want = line_classes(UNBROKEN)
    got = {r["doc_id"]: r["dropped"] for r in lines.report(docs).collect()}
    assert want and got == {i: want.get(i, []) for i in range(len(rows))}
    sets = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(lines.shingles(F.col("text"))).alias("n")).collect()}
    assert sets == {i: len(shingles(x)) for i, x in enumerate(UNBROKEN)}


def test_copies_of_a_line_make_few_links(spark):
    """200 near lines around two bases and a chain between them: links grow with the lines, not with their pairs, and
    connect what any link connects; units of two blocks, too."""
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(2)]
    near = [b[:i] + "#" + b[i + 1:] for b in bases for i in range(0, 200, 2)]
    chain = [bases[0][:k] + bases[1][k:] for k in range(0, 201, 15)]
    all_ = sorted({*near, *chain})
    texts = spark.createDataFrame(list(enumerate(all_)), "k long, line string")
    entries = texts.select("k", F.lit(7).cast("long").alias("bucket"))
    want, n_links = collections.defaultdict(set), 0
    sets = [shingles(x) for x in all_]
    root = list(range(len(all_)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both >= lines.THRESHOLD * (len(s) + len(sets[j]) - both) - 1e-12:
                n_links += 1
                root[find(i)] = find(j)
    for i in range(len(all_)):
        want[find(i)].add(i)
    for block in (1024, 16):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lines, "BLOCK", block)
            links = lines._links(entries, texts).cache()
            got = collections.defaultdict(set)
            for r in components.components(links).collect():
                got[r["root"]].add(r["node"])
            assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
            assert links.count() < 3 * len(all_) < n_links / 10


def test_sketches_never_part_near_lines(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    all_ = [base[:i] + "x" * (i % 17) + base[i:] for i in range(0, 300, 5)] + ["".join(rng.choice("abc ") for _ in range(n)) for n in (1, 5, 40, 400)]
    rows = lines.sketches(spark.createDataFrame(list(enumerate(all_)), "k long, line string")).collect()
    words = {r["k"]: [r[f"s{w}"] for w in range(lines.WORDS)] for r in rows}
    sets = [shingles(x) for x in all_]
    assert {r["k"]: r["n"] for r in rows} == {i: len(s) for i, s in enumerate(sets)}
    for i, s in enumerate(sets):
        for j in range(i):
            flips = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(words[i], words[j]))
            assert flips <= len(s ^ sets[j])


@pytest.mark.parametrize("size", [10, 20, 40])
def test_line_bands_reach_the_recall(spark, size):
    """Pairs of sets of 31-bit numbers at a similarity of 0.8, through the operator's permutations."""
    pairs, both = 2000, 8 * size // 10
    rng = np.random.default_rng(size)
    rows = []
    for p in range(pairs):
        h = rng.integers(0, 2**31, size).tolist()
        rows += [(p, side, x) for side in (0, 1) for x in h[:both] + h[both + side::2]]
    each = spark.createDataFrame(rows, "p int, side int, h long").groupBy("p", "side")
    low = {(r["p"], r["side"]): r[2:] for r in each.agg(*[F.min(lines.permuted(F.col("h"), i)) for i in range(lines.BANDS * lines.ROWS)]).collect()}
    k = lines.ROWS
    hit = sum(any(low[p, 0][b:b + k] == low[p, 1][b:b + k] for b in range(0, lines.BANDS * k, k)) for p in range(pairs))
    assert hit >= 0.99 * pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(df.filter("a > 999")).count() == 0


# ------------------------------------------------------------- 7 n-gram Jaccard join
def grams(t):
    w = words(t)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_classes(docs):
    sets = [grams(t) for t in docs]
    root, links = list(range(len(docs))), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g]}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return [find(i) for i in range(len(docs))], [links[i] for i in range(len(docs))]


def test_near_duplicates_of_the_test_table(spark, sf, texts):
    ids = sorted(texts)
    root, links = near_classes([texts[i] for i in ids])
    got = by_id(spark, sf, "op7_ngram_jaccard")
    assert [(got[i]["class_id"], got[i]["n_links"]) for i in ids] == [(ids[r], n) for r, n in zip(root, links)]
    assert sum(r["kept"] for r in got.values()) == len(set(root))


@pytest.mark.parametrize("block", [512, 3])
def test_large_group_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    root, links = near_classes([t for _, t in rows])
    got = {r["doc_id"]: r for r in neardup.join(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999, block=block).collect()}
    assert [got[i]["class_id"] for i in range(40)] == root
    assert [got[i]["n_links"] for i in range(40)] == links


def test_near_duplicates_awkward(spark, awkward, empty):
    rows = neardup.join(awkward).collect()
    root, links = near_classes([t for _, t, _, _ in AWKWARD])
    assert sorted(r["n_links"] for r in rows) == sorted(links)
    assert sum(r["kept"] for r in rows) == len(set(root))
    left = neardup.keep_one(awkward)
    assert left.columns == awkward.columns and left.count() == len(set(root)) and left.filter("_row <> 'mine'").count() == 0
    assert neardup.join(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = neardup.choose_bands()
    assert bands * rows <= neardup.MOST_HASHES and 1 - (1 - 0.8 ** rows) ** bands >= 0.999


# ------------------------------------------------------------- 8 sharding
def jump_hash(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_awkward(spark, awkward, empty):
    rows = sharding.assign(awkward, 5).collect()
    keys = {d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:16], 16) for d, _, _, _ in AWKWARD}
    assert all((r["shard"], r["grown_shard"]) == (jump_hash(keys[r["doc_id"]], 5), jump_hash(keys[r["doc_id"]], 6)) for r in rows)
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in AWKWARD)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(empty, 5).count() == 0


def test_hot_key_keeps_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    df = spark.range(0, 300, 1, 6).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    by = collections.defaultdict(list)
    for r in sharding.assign(df, 4).collect():
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == 300 and all(sorted(s) == list(range(len(s))) for s in by.values())


# ------------------------------------------------------------- 9 LM scoring
def exact_scores(docs, train):
    """(n_tokens, n_known, base, score) of every text by exact counts."""
    tokens = [[*words(t), "\n"] for t in docs]
    c = collections.Counter(w for t, use in zip(tokens, train) if use for w in t)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for t, use in zip(tokens, train) if use for p in zip(["\n", *t], t))
    mass = collections.Counter()
    for (a, _), k in pairs.items():
        if k >= lm.LEAST_PAIR:
            mass[a] += k - lm.DISCOUNT
    out = []
    for t in tokens:
        base = score = 0.0
        for a, w in zip(["\n", *t], t):
            p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
            k = pairs[a, w]
            own = (k - lm.DISCOUNT) / c[a] if k >= lm.LEAST_PAIR else 0.0
            base += math.log10(p)
            score += math.log10(own + (1 - mass[a] / c[a] if c[a] else 1) * p)
        out.append((len(t), sum(c[w] > 0 for w in t), base, score))
    return n, out


def test_scores_of_the_test_table(spark, sf, texts):
    ids = sorted(texts)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
    n, want = exact_scores([texts[i] for i in ids], [not h for h in held])
    got = by_id(spark, sf, "op9_lm_scoring")
    for i, h, (tokens, known, base, score) in zip(ids, held, want):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(r["score"] - score) <= 0.06 * tokens + 1          # levels and false hits
    assert sum(got[i]["score"] - got[i]["base_score"] for i, h in zip(ids, held) if h) > 0


def test_pairs_seen_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    plain = " ".join(f"w{x}" for x in rng.permutation(400))
    other = " ".join(f"w{x}" for x in rng.permutation(400))
    copy = " ".join([*plain.split()[:300], "unseen", *plain.split()[301:]])
    docs = stored(spark, tmp_path, [(0, plain, "en", "s"), (1, copy, "en", "s"), (2, other, "en", "s")])
    got = {r["doc_id"]: r for r in lm.score(docs, lm.train(docs.filter("doc_id = 0").select("text"), log2=3)).collect()}
    seen, t = set(zip(["\n", *plain.split()], [*plain.split(), "\n"])), {0: plain, 1: copy, 2: other}
    for i in range(3):
        tokens, want = [*t[i].split(), "\n"], 0.0
        for a, w in zip(["\n", *tokens], tokens):
            p = (0.1 + (w != "unseen")) / (401 + 0.1 * 402)
            want += math.log10(((a, w) in seen) * 0.25 + (1 if a == "unseen" else 0.75) * p)
        assert got[i]["score"] == pytest.approx(want, abs=0.06 * len(tokens) + 1)
    assert got[1]["score"] > got[1]["base_score"] + 500


@pytest.mark.parametrize("segment", [1, 128 << 20])
def test_lm_awkward(spark, awkward, empty, segment):
    model = lm.train(awkward.select("text"), log2=3)
    rows = lm.score(awkward, model, segment).collect()
    _, want = exact_scores([t for _, t, _, _ in AWKWARD], [True] * len(AWKWARD))
    got = sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(w[:3] for w in want)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(w[:3] for w in want)])
    assert lm.score(empty, model).count() == 0
    blank = lm.train(empty.select("text"))
    assert blank.tokens == 0 and all(r["score"] == 0 for r in lm.score(awkward, blank).collect())


def test_filter_has_no_false_misses():
    rng = np.random.default_rng(2)
    keys, levels = rng.integers(1, 2**63, 5000).astype(np.uint64), rng.integers(1, 9, 5000)
    piece = lm.filter_piece(lm.insertions(keys, levels, lm.PAIR))
    found = lm.Filter([(0, piece)], 0, len(piece))
    read = found.levels(keys, np.zeros(5000, np.int64), lm.PAIR)
    assert (read >= levels).all() and (read > levels).mean() < 0.01
    other = rng.integers(1, 2**63, 5000).astype(np.uint64)
    assert (found.levels(other, np.zeros(5000, np.int64), lm.PAIR) > 0).mean() < 0.01


def test_filter_is_probed_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    keys, levels, bucket = rng.integers(1, 2**63, 3000).astype(np.uint64), rng.integers(0, 9, 3000), rng.integers(0, 3, 3000)
    pieces = [(b, lm.filter_piece(lm.insertions(keys[bucket == b], levels[bucket == b], lm.COUNT))) for b in (0, 1)]
    found = lm.Filter(pieces, 2, sum(len(p) for _, p in pieces))
    whole = found.levels(keys, bucket, lm.COUNT)
    assert (whole[bucket < 2] >= levels[bucket < 2]).all() and not whole[bucket == 2].any()
    sizes, probe = [], lm.Filter._has
    monkeypatch.setattr(lm, "PROBED", 700)
    monkeypatch.setattr(lm.Filter, "_has", lambda self, k, *a: sizes.append(len(k)) or probe(self, k, *a))
    assert (found.levels(keys, bucket, lm.COUNT) == whole).all() and max(sizes) <= 700
    assert len(found.levels(keys[:0], bucket[:0], lm.COUNT)) == 0


# ------------------------------------------------------------- 10 quality rules
def counts(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often, hit = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts_and_verdicts(spark, sf, texts):
    got = by_id(spark, sf, "op10_quality_rules")
    for i, t in texts.items():
        assert tuple(got[i][c] for c in COLUMNS) == counts(t)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    good = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()]
    bad = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()]
    judged = [got[i]["kept"] for i in good if not got[i]["base_failed"]]
    assert sum(judged) >= 0.98 * len(judged) and sum(got[i]["kept"] for i in bad) <= 0.3 * len(bad)


def test_quality_awkward(spark, awkward, empty):
    rows = quality.judge(awkward).collect()
    assert collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows) == collections.Counter((d, *counts(t)) for d, t, _, _ in AWKWARD)
    left = quality.keep(awkward)
    assert left.columns == awkward.columns and left.count() == sum(r["kept"] for r in rows)
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0


def test_quality_of_a_rare_language(spark, tmp_path):
    rng = np.random.default_rng(6)

    def text_of(letters, n):
        pool = ["".join(rng.choice(list(letters), 6)) for _ in range(400)]
        return " ".join(rng.choice(pool, n))
    latin, cyrillic = "abcdefghijklmnopqrst", "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a\u043b\u043c\u043d\u043e\u043f"
    rows = [(i, text_of(latin, 20_000), "en", "s") for i in range(40)]
    rows += [(100, text_of(cyrillic, 150), None, "s"), (101, text_of(cyrillic, 150), "uk", "s"), (102, text_of(cyrillic, 150), "", "s")]
    rows += [(200 + i, text_of(cyrillic, 300), "ru", "s") for i in range(9)] + [(300, text_of("0123456789", 300), "ru", "s")]
    docs = stored(spark, tmp_path, rows)
    refs = quality.references(docs)
    assert set(refs) == {"", "en", "ru"}
    kept = {r["doc_id"] for r in quality.judge(docs, refs).filter("kept").collect()}
    assert kept == {i for i, *_ in rows} - {300}
    assert {r["doc_id"] for r in quality.keep(docs, refs).collect()} == kept


def test_distance():
    p = np.array([[1.0, 0, 0], [1, 1, 2]])
    assert quality.distance(p, np.array([0, 0, 5.0])).tolist() == pytest.approx([1.0, 0.5579230452841438])
    assert quality.distance(p[1:], np.array([2, 2, 4.0]))[0] == pytest.approx(0)


# ------------------------------------------------------------- shared helpers
def test_words_in_slices(monkeypatch):
    plain = [t.encode() for t in ("ab  cd\nab", "", "x" * 50, "ab cd é " * 30)]
    h, owner, starts, ends = text.words(plain)
    slices = text._slices
    monkeypatch.setattr(text, "_slices", lambda b, p: slices(b, p, 16))
    h2, owner2, starts2, ends2 = text.words(plain)
    assert all((a == b).all() for a, b in ((h, h2), (owner, owner2), (starts, starts2), (ends, ends2)))
    joined = b"\n".join(plain) + b"\n"
    assert [joined[a:b] for a, b in zip(starts, ends)] == [w for t in plain for w in t.split()]
    assert len(set(h.tolist())) == len({w for t in plain for w in t.split()})
