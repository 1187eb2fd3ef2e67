"""Operators on whole texts against brute force: suffix and chunk dedup, SimHash, tokens, the pipeline."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hazelake.llm import chunks, decontaminate, graph, mixing, quality, simhash, suffix, tokens
from hazelake.llm.rindex import RunIndex, ranges
from hazelake.session import fresh_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ suffix dedup
def brute_removed(documents, width):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by a dictionary of all windows."""
    seen, out = {}, []
    for text in documents:
        for i in range(len(text) - width + 1):
            seen[text[i:i + width]] = seen.get(text[i:i + width], 0) + 1
    for text in documents:
        gone = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - width + 1):
            if seen[text[i:i + width]] > 1:
                gone[i:i + width] = True
        rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((len(text), int(gone.sum()), len(ranges(gone)), hashlib.sha256(rest).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(2, 14))
def test_run_index_marks_repeated_windows(strings, width):
    data = [s.encode() for s in strings]
    seen = {}
    for s in data:
        for i in range(len(s) - width + 1):
            seen[s[i:i + width]] = seen.get(s[i:i + width], 0) + 1
    for s, flags in zip(data, RunIndex(data).repeated(width)):
        assert list(flags) == [seen[s[i:i + width]] > 1 for i in range(len(s) - width + 1)]


def passages(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, common = line(150), line(45)
    texts = [line(rng.randint(0, 300)) for _ in range(12)]
    texts += [line(rng.randint(0, 90)) + shared + line(rng.randint(0, 90)) for _ in range(10)]
    texts += [line(70) + common + line(70) for _ in range(30)]
    near = line(400)
    for _ in range(12):
        at = rng.randint(0, 399)
        texts.append(near[:at] + rng.choice("xyz") + near[at + 1:])
    return texts + [texts[0], texts[0], "ab" * 200, "a" * 300, "a" * 301, "", shared * 3]


@pytest.mark.parametrize("group_bytes", [1 << 20, 2_000, 200])
def test_suffix_dedup_against_brute_force(make, group_bytes):
    """With small groups the hot keys are split down to single windows."""
    texts = passages(3) + [None]
    got = suffix.deduplicated(make(texts), width=40, gram=8, group_bytes=group_bytes).collect()
    want = brute_removed([(t or "").encode() for t in texts], 40)
    for r in got:
        kept = hashlib.sha256(bytes(r.kept)).hexdigest()
        assert (r.n_bytes, r.n_removed, len(r.spans), kept) == want[r.doc_id - 1], r.doc_id
    assert len(got) == len(texts)


def test_suffix_dedup_at_its_real_width_and_over_pieces(make, monkeypatch):
    monkeypatch.setattr(suffix.texts, "PIECE", 5_000)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(120)
    texts = [prose(900) + shared + prose(1500), prose(10) + shared, prose(3000), shared[:399], shared[10:420]]
    documents = make(texts).coalesce(1)
    pieces = [b for row, offsets, data, ends in suffix._pieces([(1, texts[0].encode())], 400) for b in ends]
    assert len(pieces) > 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.deduplicated(documents).collect()}
    assert [got[i] for i in sorted(got)] == brute_removed([t.encode() for t in texts], 400)


def test_suffix_dedup_looks_heavy_segments_up_where_they_are(make, monkeypatch):
    monkeypatch.setattr(suffix, "HEAVY", 2)
    texts = passages(3) + ["heavy " * 30] * 9
    got = suffix.deduplicated(make(texts), width=40, gram=8).collect()
    want = brute_removed([t.encode() for t in texts], 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans)) for r in got} == {i: w[:3] for i, w in enumerate(want, 1)}


def test_strings_shared_with_another_text_are_noted(make):
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared, short = line(39), line(7)
    texts = [line(200) + shared + line(50), shared, line(3) + shared + line(90), line(300), line(20) + short + line(300), short, "", None, "q" * 400]
    got = {r.doc_id: r.n_shared for r in suffix.deduplicated(make(texts), width=400, gram=8, among=32).collect()}
    assert all(got[i] > 0 for i in (1, 2, 3)) and not any(got[i] for i in range(4, 10))


def test_suffix_dedup_takes_odd_tables(docs, none):
    got = suffix.deduplicated(docs)
    assert got.count() == docs.count() and suffix.deduplicated(none).count() == 0


# ------------------------------------------------------------------ chunks
def test_cuts_resist_shifts():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    moved = text[:5_000] + b"inserted" + text[5_000:]
    a, b = set(chunks.cuts(text)), {c - 8 for c in chunks.cuts(moved) if c > 5_008}
    later = {c for c in a if c > 5_200}
    assert later <= b | {len(text)} and len(later) > 200


def test_long_texts_behind_empty_ones_are_cut_into_pieces():
    import pyarrow as pa
    import zstandard

    long = np.random.default_rng(4).integers(97, 123, 5 << 20, dtype=np.uint8).tobytes()

    def segments(*contents):
        packed = [zstandard.ZstdCompressor(level=1).compress(c) for c in contents]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(contents))), pa.array(packed, pa.binary())], names=["row", "packed"])
        return [tuple(r.values()) for b in suffix._anchored(400, 32)([batch]) for r in b.drop_columns(["row"]).to_pylist()]

    alone = segments(long)
    assert segments(b"", long) == alone and segments(b"", b"", long) == alone
    assert segments(long, b"", long) == 2 * alone
    with pytest.raises(ValueError):
        suffix.Anchors(400, 32).segments(np.zeros((1 << suffix.PLACE_BITS) + 1, np.uint8), np.array([(1 << suffix.PLACE_BITS) + 1]))


def test_cuts_do_not_depend_on_pieces():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(30_000)) + b"a" * 9_000
    assert list(chunks.cuts(text, piece=1_000)) == list(chunks.cuts(text))
    assert np.diff(chunks.cuts(text)).max() <= chunks.LONGEST
    assert list(chunks.cuts(b"")) in ([], [0]) and list(chunks.cuts(b"abc")) == [3]


def test_repeated_passages_are_found_and_kept_once(make):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = prose(55)
    texts = [prose(80) + " " + shared + " " + prose(80) for _ in range(40)] + [prose(150) for _ in range(40)] + [None, "", "same short text"] * 2
    got = {r.doc_id: r for r in chunks.repeats(make(texts)).collect()}
    assert set(got) == set(range(1, 41))
    assert got[1].n_removed == 0 and all(got[i].n_removed > 60 for i in range(2, 41))
    kept = {r.doc_id: bytes(r.kept).decode() for r in chunks.deduplicated(make(texts)).collect()}
    assert kept[1] == texts[0] and kept[50] == texts[49] and len(kept) == len(texts)
    for i in range(2, 41):
        assert kept[i].startswith(texts[i - 1][:200]) and len(kept[i]) < len(texts[i - 1])


def brute_repeats(texts, least):
    """{number: (bytes in repeated runs, removed spans)} from a dictionary of all chunks."""
    cut = {}
    places = {}
    for i, t in enumerate(texts, 1):
        data, at = (t or "").encode(), 0
        cut[i] = []
        for end in (int(e) for e in chunks.cuts(data)):
            cut[i].append((at, end))
            places.setdefault(data[at:end], []).append((i, at))
            at = end
        assert at == len(data)
    out = {}
    for i, t in enumerate(texts, 1):
        data, runs = (t or "").encode(), []
        for a, b in cut[i]:
            if len(places[data[a:b]]) > 1:
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, b))
                else:
                    runs.append([(a, b)])
        good = [r for r in runs if r[-1][1] - r[0][0] >= least]
        gone = sorted(x for r in good for x in r if min(places[data[x[0]:x[1]]]) != (i, x[0]))
        merged = []
        for a, b in gone:
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        if good:
            out[i] = (sum(r[-1][1] - r[0][0] for r in good), merged)
    return out


@pytest.mark.parametrize("seed, least", [(1, 64), (2, 30), (3, 200)])
def test_repeats_against_a_dictionary_of_chunks(make, seed, least):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = [prose(n) for n in (12, 30, 90)]
    texts = [prose(rng.randint(0, 40)) + "".join(rng.choice(["", *shared]) + prose(rng.randint(0, 30)) for _ in range(3)) for _ in range(40)]
    texts += [None, "", texts[3], texts[3], shared[2] * 3, "a" * 5000, "b" + "a" * 5000]
    got = {r.doc_id: (r.n_repeated, r.n_removed, [(x.start, x.end) for x in r.spans]) for r in chunks.repeats(make(texts), least=least).collect()}
    want = brute_repeats(texts, least)
    assert got == {i: (n, sum(b - a for a, b in spans), spans) for i, (n, spans) in want.items()} and len(want) > 20


def test_chunks_take_odd_tables(docs, none):
    assert chunks.deduplicated(docs).count() == docs.count()
    assert chunks.repeats(none).count() == 0 and chunks.deduplicated(none).count() == 0


# ------------------------------------------------------------------ SimHash
def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius):
    """Least id per row over (id, fingerprint)."""
    label = list(range(len(pairs)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(pairs):
            for j, (_, b) in enumerate(pairs):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = {}
    for (doc, _), at in zip(pairs, label):
        ids.setdefault(at, []).append(doc)
    return [min((d for d in ids[at] if d is not None), default=None) for at in label]


def test_fingerprints(texts, monkeypatch):
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t or "") for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t or "") for t in texts[:30]] == want[:30]


def test_components_against_brute_force(docs, none):
    data = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = sorted(((d, f, c) for (d, f), c in zip(data, brute_components(data, 2))), key=repr)
    got = sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_keep_components_of_clustered_fingerprints(spark, tile, monkeypatch):
    """Small tiles send most block values through tile pairs; a large one has big matrices."""
    rng = random.Random(8)
    values = set()
    for _ in range(15):
        seed = rng.getrandbits(64)
        for _ in range(25):
            seed ^= 1 << rng.randrange(64) ^ rng.choice([0, 1 << rng.randrange(64), 1 << rng.randrange(64) | 1 << rng.randrange(64)])
            values.add(seed)
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 15, (1 << 64) - 1}
    values = sorted(values)
    monkeypatch.setattr(simhash.tiles, "__defaults__", (tile,))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 2).collect()
    for r in found:
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 2
    edges = spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in graph.components(edges).collect()}
    own = [roots.get(v, v) for v in values]
    want = brute_components([(i, v) for i, v in enumerate(values)], 2)
    groups = {}
    for i, (root, label) in enumerate(zip(own, want)):
        assert groups.setdefault(label, root) == root
    assert len(set(own)) == len(set(want))


def test_one_of_each_carries_columns_of_any_name(spark):
    documents = spark.createDataFrame([(1, "a b c d", 1, 2), (2, "a b c d", 3, 4), (3, None, 5, 6)], "doc_id long, text string, _chosen long, row long")
    assert rows(simhash.one_of_each(documents)) == [(1, "a b c d", 1, 2), (3, None, 5, 6)]


def test_one_of_each_component_stays(docs, none):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    classes = {r.component_id for r in simhash.near_duplicates(docs).where("component_id IS NOT NULL").collect()}
    kept = [r.doc_id for r in left.collect()]
    assert classes <= set(kept) and left.count() < docs.count()
    assert len(kept) == len({brute for brute in brute_components([(i, brute_fingerprint(r.text)) for i, r in enumerate(docs.collect())], 2)})
    assert simhash.one_of_each(none).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 301)}, **{i: 1000 for i in range(1001, 1100)}}


# ------------------------------------------------------------------ tokens
@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, (1 << 32) - 1)), max_size=40))
def test_codes_round_trip(numbers):
    control, data = tokens.encode_ranks(np.array(numbers, dtype="<u4"))
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert tokens.decode_ranks(control, data, len(numbers)).tolist() == numbers


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sé1\n\t .,    \x1c᠎​|<"), max_size=30))
def test_words_give_the_ids_of_whole_texts(library, text):
    words = tokens.loaded(tokens.tokenizer_path())
    (got,) = words.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == library(text)
    cut = b"".join(b for p in tokens.parts(text, 4) for b in words.encode([p]))
    assert np.frombuffer(cut, "<u4").tolist() == library(text)


def test_white_space_beside_line_feeds_encodes_like_the_library(library):
    draw = random.Random(5)
    parts = ["a", "The", "été", "\n", "\n", " ", " ", "\t", "\r", "\x0b", "\x1c", "\u0085", "\u00a0", "\u3000", "\u200b", "'s", "1", ".", "!?", "日"]
    words = tokens.loaded(tokens.tokenizer_path())
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(5_000)]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), repr(text)


def test_added_tokens_keep_their_ids(spark, make, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path())
    expected = lambda text: whole.encode(text, add_special_tokens=False).ids
    assert expected("x<|endoftext|>y") == [87, 50256, 88]
    words = tokens.loaded(tokens.tokenizer_path())
    draw = random.Random(7)
    bits = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<|", "a", "The", " ", "  ", "\n", "1", ".", "'s", "é"]
    texts = ["x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> ", *("".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(3_000))]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == expected(text), repr(text)
    monkeypatch.setattr(tokens.parts, "__defaults__", (4,))
    for text in texts:
        assert np.frombuffer(words.encode_long(text), "<u4").tolist() == expected(text), repr(text)
    monkeypatch.undo()
    folder = str(tmp_path / "ids")
    tokens.write(make(texts[:40]), folder)
    got = {r.doc_id: r for r in tokens.summary(spark, folder).collect()}
    ids = [[*expected(t), 2] for t in texts[:40]]
    assert sorted(r.n_tokens for r in got.values()) == sorted(map(len, ids))
    assert sorted(r.ids_crc32 for r in got.values()) == sorted(zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids)


def test_files_hold_all_documents_in_order(spark, docs, none, library, tmp_path):
    folder = str(tmp_path / "ids")
    tokens.write(docs, folder)
    got = sorted(tokens.read(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == docs.count()
    at = 0
    by_doc = {}
    for r in docs.collect():
        by_doc.setdefault(r.doc_id, []).append([*library(r.text or ""), 2])
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert own in by_doc[r.doc_id] and r.start == at and r.n_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        at += len(own)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)
    empty = str(tmp_path / "none")
    tokens.write(none, empty)
    assert tokens.read(spark, empty).count() == 0


def test_small_blocks_add_up(spark, make, library, tmp_path):
    folder = str(tmp_path / "ids")
    texts = [f"text number {i} of many {'x' * 80} " * 40 for i in range(60)]
    tokens.write(make(texts), folder, block_ids=3_000)
    assert pq.read_table(folder + "/ids").num_rows > 10
    got = tokens.summary(spark, folder).orderBy("doc_id").collect()
    sizes = [len(library(t)) + 1 for t in texts]
    assert [r.n_tokens for r in got] == sizes
    assert [r.start for r in got] == [sum(sizes[:i]) for i in range(len(sizes))]


# ------------------------------------------------------------------ the pipeline
def test_stages_follow_one_another(spark, docs, tmp_path):
    leak = "Thblewh outhan. This therble haorble enesou bleha he, with he, the toanshedha eseser that thinon tionhaheonhere thretint"
    extra = spark.createDataFrame([(900, "well " + leak + " so it goes", "en", "s1", 1, "r", "k", 1, "w")], docs.schema)
    documents = docs.unionByName(extra)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    out, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, out, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append(out)
    kept, one, clean, mixed, last = seen
    assert all(x.columns == documents.columns for x in seen[:4])
    assert rows(kept) == rows(quality.keep(documents))
    assert kept.where("doc_id = 900").count() == 1 and clean.where("doc_id = 900").count() == 0
    assert clean.count() == one.count() - 1
    assert mixed.count() == sum(1 for r in mixing.assigned(clean).collect() for t in r.turns if t.words)
    assert last.count() == mixed.count() and last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    # documents taken twice are rows twice; what is left of them is the same
    assert rows(whole.select("doc_id", "n_tokens")) == rows(last.select("doc_id", "n_tokens"))
    assert decontaminate.leaks(mixed, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 0


def test_tokens_follow_the_order_of_the_files(spark, make, tmp_path):
    """A mix in training order is tokenised in that order, passes apart, split files and blocks included, without a shuffle."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    path, folder = str(tmp_path / "mix"), str(tmp_path / "tokens")
    mixed = mixing.mix(make(texts))
    mixed.write.option("parquet.block.size", 4096).parquet(path)
    docs = spark.read.parquet(path)
    given = docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert len({r.doc_id for r in given}) < len(given)  # some have two passes
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        tokens.write(docs, folder, block_ids=500, as_stored=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted(tokens.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in given]
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    by_text = tmp_path / "by-id"
    tokens.write(make(texts), str(by_text))
    want = {r.doc_id: bytes(r.ids) for r in tokens.read(spark, str(by_text)).collect()}
    assert sum(bytes(r.ids) == want[r.doc_id] for r in got) >= len(got) - 2  # one document per source may be cut


def test_no_token_files_from_an_empty_stage(spark, none, tmp_path):
    none.select("doc_id", "text").write.parquet(str(tmp_path / "none"))
    tokens.write(spark.read.parquet(str(tmp_path / "none")), str(tmp_path / "out"), as_stored=True)
    assert tokens.read(spark, str(tmp_path / "out")).count() == 0


def test_blocks_stand_in_small_row_groups(spark, tmp_path):
    """Writers hold a row group, readers all its rows at once: a file of many blocks must have several."""
    docs = spark.range(1, 41).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 1 << 18).alias("text")).coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, known = spark.conf.get(key), set(Path(fresh_path(spark, "x")).parent.glob("token-ids-*"))
    tokens.write(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "out"), as_stored=True)
    assert spark.conf.get(key) == before
    (folder,) = set(Path(fresh_path(spark, "x")).parent.glob("token-ids-*")) - known
    groups = [m.row_group(i) for f in folder.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40
    assert max(g.num_rows for g in groups) <= 2 * tokens.HANDED // (4 << 18)
    assert tokens.summary(spark, str(tmp_path / "out")).count() == 40
