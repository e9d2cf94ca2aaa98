"""Operators against brute force, and their defined edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("gridloom.llm")

from gridloom.llm import audio, components, dedup, fuse, html, jaccard, linededup, mixing, packing, quality, repair, tokens, transducer  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = "word " * 20_000
    rows = [(1, "a b c d e", "en", "x", 9), (1, "a b c d e", "en", "x", 9), (2, "a  b\tc d e", None, None, None), (3, None, "en", "x", 0), (4, "", "en", "y", 0), (None, "a b c d e", "en", "y", 9), (None, "zz", None, None, None), (5, long, "en", "x", 1), (6, long + "tail", "en", "x", 1), (7, "   \n ", "en", "x", 5), (8, "Ünï <|endoftext|> 漢字 😀", "de", "x", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 exact dedup


def brute_groups(rows):
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return {(i, hashlib.sha256(norm(t).encode()).hexdigest()): (min((x for x in by[norm(t)] if x is not None), default=None), len(by[norm(t)])) for i, t in rows}


def test_exact_duplicates(spark, odd):
    got = dedup.exact_duplicates(odd).collect()
    want = brute_groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert len(got) == odd.count()
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["doc_id"], r["text_sha256"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_arrivals_meet_the_snapshot(spark):
    texts = [random.Random(i % 40).choice("abcdef") * (1 + i % 40) for i in range(200)]
    df = make(spark, texts)
    for arriving in (F.col("doc_id") >= 100, F.lit(True), F.lit(False)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup.exact_duplicates(df, arriving).collect()}
        want = brute_groups(list(enumerate(texts)))
        assert got == {i: want[i, hashlib.sha256(t.encode()).hexdigest()] for i, t in enumerate(texts)}


def test_exact_empty_and_drop(spark, empty, odd):
    assert dedup.exact_duplicates(empty).count() == 0
    kept = dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_fuse_filter_has_all_its_keys(keys):
    k = np.array(sorted(keys), np.uint64)
    f = fuse.BinaryFuse.from_bytes(fuse.BinaryFuse.build(k).to_bytes())
    assert f.has(k).all()
    assert f.has(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 1e-3


# 2 token counts, 5 packing, 9 files


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'stredvlmS 1٣\n\t é漢!-ΣİSß"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_encoders_equal_the_library(texts):
    texts = [*texts, "x<|endoftext|>y <|startoftext|>"]
    for path in (BYTE, WORD):
        want = [e.ids for e in library_of(path).encode_batch(texts, add_special_tokens=False)]
        got = [np.frombuffer(b, tokens.encoder(path).dtype).tolist() for b in tokens.encoder(path).encode(texts)]
        assert got == want
    assert tokens.counter(BYTE).count(texts).tolist() == [len(e.ids) for e in library_of(BYTE).encode_batch(texts, add_special_tokens=False)]


def test_merge_table_equals_the_model():
    """The merge table and the library's model piece by piece give the same ids; NUL in a text takes the model."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("etaoin shrdlu'é1\n"), 400)) for _ in range(50)] + ["x" * 5000, " " * 3000 + "y", "a\0b", "\0", "\0\0 c"]
    for path in (BYTE, WORD):
        with_table = tokens.encoder(path)
        assert with_table.merger is not None
        by_model = tokens.Encoder(path)
        by_model.merger = None
        assert with_table.encode(texts) == by_model.encode(texts)
        want = [e.ids for e in library_of(path).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, with_table.dtype).tolist() for b in with_table.encode(texts)] == want


_libraries = {}


def library_of(path):
    return _libraries.setdefault(path, library(path))


def test_chunk_maps_compose():
    """Marks do not depend on where the stream is cut into chunks."""
    cutter = transducer.Cutter(True, False)
    symbols = np.random.default_rng(1).integers(0, transducer.N_CLASSES, 5000).astype(np.uint8)
    whole = cutter.marks(symbols)
    for size in (1, 7, 64, 4999):
        cutter.CHUNK = size
        assert np.array_equal(cutter.marks(symbols), whole)


def test_count_tokens(spark, odd, empty):
    got = tokens.count_tokens(odd.withColumn("extra", F.lit(1)), BYTE, limit=4)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "extra", "n_bytes", "n_tokens", "over_limit"]
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(library_of(BYTE).encode(t, add_special_tokens=False).ids) for t in texts)
    assert tokens.count_tokens(empty, BYTE).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(odd.withColumn("n_tokens", F.lit(1)), BYTE)


def test_hilbert_curve_is_a_path():
    side = 8
    points = np.stack(np.meshgrid(*[np.arange(side)] * 3), -1).reshape(-1, 3)
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert len(set(packing.hilbert(points, 3).tolist())) == side**3
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def check_pieces(rows, texts):
    """Every id of every text in exactly one piece, sequences gapless and at most 1024 long."""
    want = {}
    for i, t in texts:
        ids = np.array([*library_of(BYTE).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append(ids)
    seqs, covered = {}, {}
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in want[r["doc_id"]])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {i: sum(map(len, x)) for i, x in want.items()}
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing(spark, odd, empty):
    check_pieces(packing.pieces_digest(packing.pack(odd, BYTE)).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=200), max_size=8))
def test_grammar_round_trip(docs):
    docs = [np.array(d, np.int64) for d in docs]
    shard = repair.Shard(repair.to_blob(docs, 6))
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d.tolist()
    whole = [x for d in docs for x in d.tolist()]
    for a in range(0, len(whole), 7):
        assert shard.ids(a, min(len(whole), a + 5)).tolist() == whole[a : a + 5]


def test_grammar_compresses():
    ids = np.tile(np.arange(50), 400)
    assert len(repair.to_blob([ids], 49408)) < len(ids)
    with pytest.raises(ValueError):
        repair.Shard(b"nothing of the kind")


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    many = np.repeat(rng.permutation(60_000).reshape(-1, 2), 8, axis=0)
    for ids in (np.tile(np.arange(50), 400), np.zeros(5000, int), many[rng.permutation(len(many))].ravel()):
        seq = repair.compress(ids, 60_000)[0].astype(np.int64)
        assert np.unique(seq[:-1] << 32 | seq[1:], return_counts=True)[1].max(initial=0) < repair.LEAST_COUNT
        assert repair.Shard(repair.to_blob([ids], 60_000)).document(0).tolist() == ids.tolist()


def test_files(spark, odd, empty, tmp_path):
    path = f"file://{tmp_path}/ids"
    repair.write_shards(odd, path, WORD)
    got = repair.read_shards(spark, path).orderBy("start").collect()
    at = 0
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    for r, (_, i, t) in zip(got, rows, strict=True):
        ids = np.array([*library_of(WORD).encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    repair.write_shards(empty, path + "0", WORD)
    assert repair.read_shards(spark, path + "0").count() == 0


# 3 quality


def test_quality(spark):
    rng = random.Random(5)
    good = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    text = lambda bad: " ".join(rng.choice(good) + ("!!" if bad else "") for _ in range(40))
    texts = [text(i % 4 == 0) for i in range(600)]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(None, 1, 0), (9999, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample=150)
    got = quality.score(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 100 and all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    with pytest.raises(quality.NoClasses):
        quality.train(docs, labels.where("quality = 1"))


def test_scores_do_not_depend_on_neighbours(spark, odd, empty):
    model = quality.Model(np.random.default_rng(1).standard_normal(quality.BUCKETS).astype(np.float32), 0.2)
    texts = [r["text"] or "" for r in odd.collect()]
    assert np.allclose(model.scores(texts), np.concatenate([model.scores([t]) for t in texts]))
    assert quality.score(empty, model).count() == 0
    assert quality.score(odd, model, keep_text=True).columns == [*odd.columns, "score", "predicted"]


# 4 lines


def test_repeated_runs(spark):
    rng = random.Random(11)
    lines = ["a b", "c", "d e f", " a b ", "", "g", "h i j k"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    got = [r["text"] for r in linededup.drop_repeated_runs(make(spark, texts), min_words=5).orderBy("doc_id").collect()]
    # Earlier starts inside one document are also earlier occurrences.
    assert got == brute_lines_by_start(texts, 5)


def brute_lines_by_start(texts, least):
    seqs = [[(k, x.strip(" \t\n\r\x0b\x0c"), len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, seq in enumerate(seqs):
        for a in range(len(seq)):
            for b in range(a, len(seq)):
                if sum(w for _, _, w in seq[a : b + 1]) >= least and first.setdefault(tuple(x for _, x, _ in seq[a : b + 1]), (d, a)) != (d, a):
                    gone[d] |= {k for k, _, _ in seq[a : b + 1]}
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(texts)]


def test_lines_edge_cases(spark, odd, empty):
    out = linededup.drop_repeated_runs(odd.withColumn("extra", F.lit(1)), min_words=4)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "extra", "n_lines", "removed_lines"]
    assert out.where("text IS NULL").count() == 1
    assert linededup.drop_repeated_runs(empty).count() == 0
    with pytest.raises(ValueError):
        linededup.drop_repeated_runs(odd.withColumn("n_lines", F.lit(1)))


# 6 audio


def test_g711_tables():
    # Fixed values of ITU-T G.711: extremes and zero.
    assert audio.MULAW_TABLE[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert audio.ALAW_TABLE[[0x2A, 0xAA, 0x55, 0xD5]].tolist() == [-32256, 32256, -8, 8]
    assert len(set(audio.ALAW_TABLE.tolist())) == 256 and len(set(audio.MULAW_TABLE.tolist())) == 255


def one_block(block):
    """One ADPCM block, sample by sample."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = audio.STEPS[index]
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + audio.MOVES[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(2).integers(0, 256, (20, 36), np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [one_block(bytes(b)) for b in blocks]
    pcm, rate = audio.decode(audio.to_wave(blocks.tobytes(), audio.ADPCM, 8000, 36))
    assert rate == 8000 and pcm.tolist() == audio.decode_adpcm(blocks).ravel().tolist()
    with pytest.raises(ValueError):
        audio.from_wave(audio.to_wave(b"x" * 192, audio.MULAW)[:-10])


def test_audio_columns(spark, odd, empty):
    got = audio.audio_columns(odd.select("doc_id", "text")).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    for r, t in zip(got, texts):
        data = t.encode()
        load = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(load), hashlib.sha256(load).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(load[-16:]) and audio.from_wave(bytes(r["media"]))[3] == load
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
        assert len(r["pcm"]) == 4 * len(load)
    assert audio.audio_columns(empty).count() == 0
    assert audio.resample(np.array([0, 10, 20], np.int16), 8000, 12000).tolist() == [0, 6, 13, 20]


def test_media_are_stored(spark, odd, empty, tmp_path):
    docs = odd.select("doc_id", "text")
    audio.store_media(docs, f"file://{tmp_path}/media")
    stored, whole = spark.read.parquet(f"file://{tmp_path}/media"), audio.audio_columns(docs)
    key = lambda r: (r["media_sha256"], str(r["doc_id"]))
    assert stored.columns == ["doc_id", "n_bytes", "media", "pcm"]
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, whole.select(stored.columns).collect()), key=str)
    assert sorted(audio.read_media(stored).collect(), key=key) == sorted(whole.drop("media", "pcm").collect(), key=key)
    audio.store_media(empty.select("doc_id", "text"), f"file://{tmp_path}/none")
    assert audio.read_media(spark.read.parquet(f"file://{tmp_path}/none")).count() == 0


def test_op6_reads_what_it_stored(spark):
    from pathlib import Path

    from gridloom.llm._common import shared_dir
    from gridloom.llm.queries import op6_telephony_audio

    shared = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(shared.rglob("*.parquet"))
    got = op6_telephony_audio(spark, "/root/testdata/sf0.001").count()
    new = [str(p) for p in set(shared.rglob("*.parquet")) - before if p.is_file()]
    assert new and sum(spark.read.parquet(f"file://{p}").where("length(media) > 0 AND length(pcm) > 0").count() for p in new) == got


# 7 near duplicates


def brute_components(rows, words, percent):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def test_near_components(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(150):
        w = list(base[i % 6] if i % 5 else base[rng.randint(0, 5)][:30] + base[i % 6][:30])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(w).upper() if i % 7 == 0 else " ".join(w))
    texts += ["", None, "a b", "A b", "a b c", "one two three four"]
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(make(spark, texts), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_near_edge_cases(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(odd, 5, 80).collect()), key=key)
    assert got == sorted(brute_components(rows, 5, 80), key=key)
    assert jaccard.near_components(empty).count() == 0
    kept = jaccard.drop_near_duplicates(odd.where("doc_id IS NOT NULL").dropDuplicates())
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 200), (200, 250)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 250: 200, 300: 200}


# 8 pages

PAGE = """<html><body><header class="site-header"><h1>Site name</h1></header><div id="cookie-notice"><p>We use cookies to make this site better.</p></div>
<div class="wrap has-sidebar"><div class="post-content"><h2>Title here</h2><p>First paragraph of the story, with words enough.</p><p>Short.</p><ul><li>one item<li>two &eacute;</ul>
<p>Last <a href=x>linked</a> paragraph&nbsp;a &lt; b.</div><div class="sidebar"><p>Popular posts this week are here.</p></div><div class="comments"><p>Great article, I loved it so much. Thanks!</p></div></div>
<form><label>Name</label><input></form><footer><p>Copyright</p></footer><script>var a="<p>no</p>"</script></body>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title here\n\nFirst paragraph of the story, with words enough.\n\nShort.\n\none item\n\ntwo é\n\nLast linked paragraph a < b."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a>Home</a></nav>") == ""
    assert html.main_text("<article><p>An unclosed paragraph of words. <b>Bold <p>Next &am") == "An unclosed paragraph of words. Bold\n\nNext &am"


def test_elements_without_text_of_the_page():
    words = "The story has a first paragraph with words enough to be read."
    article = f"<article><p>{words}</p><p>And a second one.</p></article>"
    whole = f"{words}\n\nAnd a second one."
    assert html.main_text("<form><input list=x><datalist id=x><option value=a><option value=b></datalist></form>" + article) == whole
    assert html.main_text("<div><select><option>Red<option>Blue</select></div>" + article) == whole
    for tag in ("canvas", "video", "object", "audio", "svg", "template", "select", "option"):
        assert html.main_text(f"<{tag} id=x>{article}") == whole, tag
        assert html.main_text(f"<div><{tag}></div>{article}<div><{tag}>Not shown.</{tag}></div>") == whole, tag
        if tag != "option":
            assert html.main_text(f"<article><p>The story <{tag}><p>Not shown here.</p></{tag}>has words.</p></article>") == "The story has words.", tag
    assert html.main_text("<article><p>A line with <a href=x><svg><text>icon</text></svg>a link</a> in it.</p></article>") == "A line with a link in it."
    assert html.main_text("<article><p>Let <math><mfrac><mn>1</mn><mi>x</mi></mfrac></math> be small.</p></article>") == "Let 1 x be small."
    assert html.main_text("<article><p>Words before <video>not shown</article><p>after</video>") == "Words before"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=7), st.data())
def test_minimum_cut(costs, data):
    pairs = [(i, j, data.draw(st.floats(0, 3))) for i in range(len(costs)) for j in range(i) if data.draw(st.booleans())]

    def energy(side):
        return sum(-z if z < 0 and s else z if z > 0 and not s else 0 for z, s in zip(costs, side)) + sum(w for i, j, w in pairs if side[i] != side[j])

    best = min(energy([bool(m >> i & 1) for i in range(len(costs))]) for m in range(1 << len(costs)))
    assert energy(html.min_cut(costs, pairs)) == pytest.approx(best, abs=1e-6)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) > 50 and got[2]["text"] == got[3]["text"] == ""
    assert html.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html.extract(pages.withColumn("n_chars", F.lit(1)))


# 10 mixing


def test_poisson_counts(spark):
    docs = make(spark, ["t"] * 4000, "a").unionByName(make(spark, ["t"] * 1000, "b"))
    got = mixing.mix(docs, {"a": 1, "b": 3})
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["a"] == pytest.approx(1250, rel=0.1) and n["b"] == pytest.approx(3750, rel=0.1)
    spread = got.where("source = 'b'").groupBy("doc_id").count().collect()
    zero = 1000 - len(spread)
    assert zero / 1000 == pytest.approx(np.exp(-3.75), abs=0.02)
    again = mixing.mix(docs.repartition(7), {"a": 1, "b": 3})
    assert got.select("doc_id", "source", "copy").exceptAll(again.select("doc_id", "source", "copy")).count() == 0


def test_large_poisson_rates(spark):
    from math import exp, lgamma, log

    rates = [0.0, 0.5, 59.0, 400.0, 401.0, 744.0, 800.0, 20_000.0]
    table = spark.createDataFrame([(x,) for x in rates], "r double")
    for x, first, cdf in table.select("r", mixing.poisson_first(F.col("r")), mixing.poisson_cdf(F.col("r"))).collect():
        terms = [exp(n * log(x) - x - lgamma(n + 1)) if x else float(n == 0) for n in range(first + len(cdf))]
        assert sum(terms[:first]) < 2**-33 and np.allclose(cdf, np.cumsum(terms)[first:], rtol=0, atol=1e-9) and cdf[-1] > 1 - 2**-33
    got = mixing.mix(make(spark, ["t"] * 200), size=800.0).groupBy("doc_id").count().toPandas()["count"]
    assert got.mean() == pytest.approx(800, abs=8) and got.var() == pytest.approx(800, rel=0.4)


def test_mixing_edge_cases(spark, odd, empty):
    out = mixing.mix(odd.withColumn("extra", F.lit(1)), size=3.0)
    assert out.columns == [*odd.columns, "extra", "copy", "mix_rate", "mix_key"] and out.count() > 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd, {"nowhere": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd.withColumn("copy", F.lit(1)))


# internal names, maps, codes


def test_clashing_names(spark, odd):
    """Columns of the caller may be called anything that an operator uses inside."""
    names = ["_id", "_hash", "_n", "_source", "_cdf", "_first", "_doc", "gone", "text_sha256", "kept_id", "kept_hash", "sha", "kept_sha", "row", "n", "digest", "group", "lead", "bucket", "key", "list", "root", "ids", "curve", "rank", "level"]
    wide = odd.select("*", *(F.concat_ws("-", F.lit(n), F.col("doc_id"), F.xxhash64("text")).alias(n) for n in names))
    for stage in (dedup.drop_duplicates, jaccard.drop_near_duplicates, lambda d: mixing.mix(d, {"x": 1.0, "y": 1.0}, 5.0).select(*d.columns), linededup.drop_repeated_runs):
        plain = sorted(map(tuple, stage(odd).select("doc_id", "lang", "source", "text").collect()), key=str)
        got = stage(wide)
        assert sorted(map(tuple, got.select("doc_id", "lang", "source", "text").collect()), key=str) == plain
        for r in got.collect():
            assert all(r[n].startswith(n + "-") for n in names)
    for run in (dedup.exact_duplicates, jaccard.near_components, lambda d: packing.pack(d, BYTE), lambda d: tokens.count_tokens(d, BYTE), lambda d: audio.audio_columns(d)):
        assert run(wide).count() == run(odd).count()


@settings(max_examples=30, deadline=None)
@given(st.integers(520, 3000), st.integers(0, 400), st.integers(0, 400))
def test_wide_maps_never_lose_a_pair(common, left, right):
    r = np.random.default_rng(common * 1000 + left)
    every = np.unique(r.integers(0, 2**64, common + left + right, np.uint64))
    r.shuffle(every)
    a, b = np.sort(every[: common + left]), np.sort(np.concatenate([every[:common], every[common + left :]]))
    x, y = jaccard.wide_map(a), jaccard.wide_map(b)
    if len(x) > len(y):
        x, y = y, x
    if len(y) == 2 * len(x):
        y = y[: len(x)] ^ y[len(x) :]
    assert len(x) == len(y)
    assert sum(int(v & (2**64 - 1)).bit_count() for v in (x ^ y).tolist()) <= len(np.setxor1d(a, b))


def test_large_sets_are_compared(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    near, far = base.copy(), base.copy()
    for i in r.sample(range(3000), 60):
        near[i] = "x"
    for i in r.sample(range(3000), 400):
        far[i] = "y"
    texts = [" ".join(x) for x in (base, near, far, [f"v{r.randrange(10**6)}" for _ in range(2000)])]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(make(spark, texts)).collect())
    assert got == sorted(brute_components(list(enumerate(texts)), 4, 85)) and [c for _, _, c in got] == [0, 0, 2, 3]


def test_shared_shingle_of_a_third_of_all(spark):
    r = random.Random(5)
    texts = [" ".join(["all of them say"] * (i % 3 == 0) + [f"w{r.randrange(60)}" for _ in range(r.randrange(1, 6))]) for i in range(240)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_components(make(spark, texts)).collect())
    assert got == sorted(brute_components(list(enumerate(texts)), 4, 85))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-32768, 32767), min_size=1, max_size=50))
def test_coded_samples(samples):
    x = np.array(samples, np.int16)
    assert audio.decode_pcm(audio.code_pcm(x)).tolist() == samples


def test_audio_features(spark):
    """The feature string, worked out anew for one text."""
    r = audio.audio_columns(make(spark, ["some text " * 40])).first()
    load = ("some text " * 40).encode().ljust(576)
    linear = [int(audio.MULAW_TABLE[b]) for b in load]
    up = [v for i, s in enumerate(linear) for v in (s, (s + linear[min(i + 1, len(linear) - 1)]) // 2)]
    parts = r["feature"].split("|")
    mean, signs = sum(linear) // len(linear), sum((p < 0) != (q < 0) for p, q in zip(linear, linear[1:]))
    assert parts[0] == f"{sum(s * s for s in linear) // len(linear)},{mean},{max(map(abs, linear))},{signs}"
    assert int(parts[3]) == zlib.crc32(np.array(up, "<i2").tobytes())


def test_quality_learns_kinds_of_noise(spark):
    """Few labels, unseen words: repeats and broken words are told from prose, alone or beside others."""
    r = random.Random(1)
    prose = lambda: " ".join(r.choice("the of and river mountain city people water green house walked under over long".split()) + str(r.randrange(3)) * (r.random() < 0.1) for _ in range(60))
    same = lambda: " ".join(w for w in (f"q{r.randrange(10**6)}" for _ in range(6)) for _ in range(10))
    rows = [(i, same() if i % 4 == 0 else prose(), int(i % 4 != 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(4, 1), (None, 0), (1, None), (9999, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert sum(r["held_out"] for r in got) > 40
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) == (r["doc_id"] % 4 != 0) for r in got if r["held_out"])
    with pytest.raises(quality.NoClasses):
        quality.train(docs.limit(0), labels)
    with pytest.raises(ValueError):
        quality.score(docs.withColumn("score", F.lit(1)), quality.train(docs, labels))


def test_scratch_is_deleted(spark):
    from pathlib import Path

    from gridloom.llm import _common

    root = Path(_common.shared_dir(spark).removeprefix("file:").replace("//", "/"))
    before = set(root.iterdir())
    with _common.scratch(spark):
        _common.materialize(spark.range(5), "gone")
        kept = _common.materialize(spark.range(5), "stays", keep=True)
    assert len(set(root.iterdir()) - before) == 1 and kept.count() == 5


def test_names_and_depth_of_pages():
    import time

    page = "<article><p>Some words are here to be read by all.</p><p class='{}'>These words are here as well.</p></article>"
    for name in ("text-ad-free", "comment-free", "search-results-story", "promotion-theory", "has-sidebar"):
        assert html.main_text(page.format(name)).endswith("These words are here as well."), name
    for name in ("ad", "ad-slot", "main-nav", "cookie-banner", "comment-list", "relatedPosts", "site-footer", "ad-12"):
        assert html.main_text(page.format(name)).endswith("read by all."), name
    began = time.time()
    text = html.main_text("<article>" + "<div>one two three four five six.</b2>" * 100_000)
    assert text.count("one two") == 100_000 and time.time() - began < 20


def test_quality_learns_from_every_row(spark):
    """More labelled rows than a part holds: each is in a part, rows of a rare class in several, and the parts' models are averaged."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(900)] + [(7, "other text"), (7, "text 7"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 30 != 0)) for i in range(800)] + [(7, 1), (None, 0), (9999, 0)], "doc_id long, quality int")
    want = {(f"text {i}", int(i % 30 != 0)) for i in range(800) if zlib.crc32(str(i).encode()) % 3 != 1} | {("other text", 1)}
    rows = quality.training_rows(docs, labels, sample=40).collect()
    assert len(rows) >= len(want)
    assert {(r["text"], r["quality"]) for r in rows} == want and len({(r["text"], r["part"]) for r in rows}) == len(rows)
    parts = [[r["quality"] for r in rows if r["part"] == p] for p in sorted({r["part"] for r in rows})]
    assert len(parts) == -(-len(want) // 80) and all(set(p) == {0, 1} for p in parts)
    model = quality.train(docs, labels, sample=40)
    assert np.array_equal(model.weights, quality.train(docs, labels, sample=40).weights) and model.weights.shape == (quality.BUCKETS,)


def test_quality_learns_from_all_features_of_a_long_text(spark):
    """What tells the classes apart has the highest table rows of texts with thousands of features."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    base = [word() for _ in range(900)]
    rows_of = lambda t: np.unique(np.concatenate([rows for rows, _ in quality.features([t])]))
    cut = rows_of(" ".join(base))[4096 - 1]
    # Three words in a row have one pattern here, so that words alone differ.
    marks = [w for w in (word() for _ in range(20_000)) if min(rows[0] for rows, _ in quality.features([w]) if len(rows)) > cut and rows_of(f"{w} {w}").min() > cut][:2]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(base, len(base)) + [marks[i % 2]] * 200)) for i in range(120)], "doc_id long, text string")
    got = quality.score(docs, quality.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"))).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 20 and all(r["predicted"] == r["doc_id"] % 2 for r in held)
