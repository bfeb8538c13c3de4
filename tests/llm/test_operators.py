"""Every operator against a plain version, on a table with the awkward rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonetape.llm import (
    byte_bpe,
    fingerprints,
    language,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    substring_dedup,
    token_counts,
    token_files,
)
from tonetape.llm.pretokens import ranks

#: Columns with names that the operators might use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, node string, gone string, kept string"


def made_rows():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(words, k=n))
    rows = []
    for i in range(60):
        lines = [prose(draw.randint(3, 20)) for _ in range(draw.randint(1, 12))]
        rows.append([i, "\n".join(lines), "ab"[i % 2], ["s1", "s2", None][i % 3]])
    passage, block = prose(70), "\n".join(prose(15) for _ in range(3))
    for i in (3, 17, 31):
        rows[i][1] += " " + passage
    for i in (5, 23):
        rows[i][1] += "\n" + block + "\n" + prose(9)
    rows.append([60, rows[7][1], "a", "s1"])  # an exact copy
    edited = rows[9][1].split(" ")
    edited[len(edited) // 2] = "changed"
    rows.append([61, " ".join(edited), "a", "s2"])
    rows += [[62, None, None, None], [63, "", "a", "s1"], [64, "  \n\t ", "b", "s1"], [65, "12 34 --", "a", "s9"]]
    rows.append([66, "to " * 30000, "a", "s1"])
    rows.append([67, "é" * 3000 + "\x1c x  y z \U0001f600 Σ <|endoftext|>", None, "s2"])
    rows += [[68, rows[2][1], "b", "s3"], [68, rows[2][1], "b", "s3"], [None, rows[4][1], "a", "s1"]]
    return [(*r, len(r[1] or ""), 1, "n", "g", "k") for r in rows]


ROWS = made_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def words_of(text):
    return (text or "").encode().split()


LAST = (1 << 63) - 1
IDS = [LAST if r[0] is None else r[0] for r in ROWS]


def test_empty_tables(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in (("embeddings", "vec_id bigint, embedding array<float>, label int"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    from tonetape.llm.queries import QUERIES

    assert {name: query(spark, str(tmp_path)).count() for name, query in QUERIES.items()} == dict.fromkeys(QUERIES, 0)


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in rows) == sorted((i is None, i, len(words_of(t))) for i, t, *_ in ROWS)
    total = sum(r.size for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in targets.items():
        taken = sum(r.taken for r in rows if r.source == source)
        largest = max(r.size for r in rows if r.source == source)
        assert target <= 2 * size and abs(taken - target) <= largest
    assert all(r.taken <= 2 * r.size for r in rows)
    repeated = mixing.repeat(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.times for r in rows)


def brute_counts(text):
    words = (text or "").encode().split()
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality(docs):
    small = docs.where("doc_id <> 66 or doc_id is null")
    frame, names, kept = quality.judge(small)
    got = sorted(tuple(r) for r in frame.select(*names[:5]).collect())
    assert got == sorted(brute_counts(r[1]) for r in ROWS if r[0] != 66)
    by_id = {r[0]: r[1] for r in frame.select("doc_id", kept).collect()}
    assert not by_id[62] and not by_id[63] and by_id[0] == (len(words_of(ROWS[0][1])) >= 50)
    assert quality.keep_good(docs).columns == docs.columns


def test_token_files(spark, docs, folder):
    rows = token_files.op4_token_files(spark, folder).orderBy("start").collect()
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    start = 0
    for row, (_, text) in zip(rows, sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in ROWS), strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_equal_the_library():
    """Words as they come in odd texts: special strings, other white space, signs, letters beyond Latin."""
    path = public_tokenizers.path(token_files.VOCABULARY)
    library, coder, draw = Tokenizer.from_file(path), token_files.tokens(path), random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "b", "İ", "é", "e\u0301", "\u00a0", "\u2003", " ", "  ", "\n", "\x1c", "\t"]
    parts += ["don't", "we'll", "x1y22", "!?", "Σς", "字", "🙂", "￼", "’s", "'S", "\u0301", "J\u030c", "T\u0308", "I\u0307", "word,", "end.", "a_b", "3.14", "K", "ǅ"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(3000)]
    ids, counts = coder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("steps", [[1], [0, 0, 0], [5, 0, 70000, 1], [3] * 5000, list(range(2000))])
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps))
    assert (token_files.Ends.of(values).all() == values).all()


def test_byte_bpe(spark, docs, folder):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    expected = []
    for i, text, *_ in ROWS:
        ids = plain.encode_ordinary(text or "")
        expected.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    rows = byte_bpe.op9_byte_bpe(spark, folder).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(expected)
    there = byte_bpe.decode(byte_bpe.encode(docs, path), path).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in there)
    assert base64.b64encode(bytes(there[0].decoded))


def test_token_counts(docs):
    model = token_counts.unigram(public_tokenizers.path(token_counts.VOCABULARY))
    from tonetape.llm.pretokens import matcher

    def brute(word):
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            tokens = ((s, model.cost.get(word[s:end])) for s in range(max(0, end - 130), end))
            best.append(min((best[s][0] + (c >> 40), best[s][1] + 1) for s, c in tokens if c is not None))
        return best[-1][1]

    rows = {r.doc_id: r.n_tokens for r in token_counts.count(docs, public_tokenizers.path(token_counts.VOCABULARY)).collect()}
    for i, text, *_ in ROWS[:20] + ROWS[62:66]:
        assert rows[i] == sum(brute(p.encode()) for p in matcher().findall(text or ""))


def brute_spans(rows):
    first = {}
    for i, text in rows:
        words = words_of(text)
        for k in range(len(words) - 49):
            run = tuple(words[k : k + 50])
            first[run] = min(first.get(run, i), i)
    out = []
    for i, text in rows:
        words = words_of(text)
        gone = set()
        for k in range(len(words) - 49):
            if first[tuple(words[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup(spark, docs, folder):
    small = [(i, r[1]) for i, r in zip(IDS, ROWS, strict=True) if r[0] != 66]
    rows = substring_dedup.op5_substring_dedup(spark, folder).where("doc_id <> 66 or doc_id is null").collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(brute_spans(small))
    assert sum(r.n_removed > 0 for r in rows) >= 3
    cleaned = substring_dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)


def test_patience_keeps_order():
    a, b = [1, 2, 3, 4, 5, 9, 9], [1, 7, 3, 4, 8, 5, 9]
    assert line_dedup.align(a, b) == [(0, 0), (2, 2), (3, 3), (4, 5), (6, 6)]
    assert line_dedup.align([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])


def test_blocks_that_come_again():
    passage, texts = [1, 2, 3], ([10, 1, 2, 3, 11], [20, 1, 2, 3, 21, 1, 2, 3, 22])
    assert line_dedup.deleted(*texts, [5] * 9, 2, 12) == [1, 2, 3, 5, 6, 7]
    assert line_dedup.deleted(texts[1], texts[0], [5] * 5, 2, 12) == [1, 2, 3]
    assert line_dedup.deleted([7, 8, *passage], [*passage, 7, 8], [5] * 5, 2, 12) == [0, 1, 2, 3, 4]
    assert line_dedup.deleted([1, 9, 2], [1, 2, 0, 9], [12, 5, 0, 11], 2, 12) == [0]


def test_nothing_goes_but_what_is_aligned(monkeypatch):
    texts = [10, 1, 2, 3, 11], [20, 1, 2, 3, 21, 1, 2, 3, 22]
    assert line_dedup.deleted(*texts, [5] * 9, 2, 12)
    monkeypatch.setattr(line_dedup, "align", lambda a, b: [])
    assert line_dedup.deleted(*texts, [5] * 9, 2, 12) == []


def test_line_dedup(docs):
    cleaned = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert cleaned[60] == "" and cleaned[62] is None and cleaned[64] == "  \n\t "
    assert cleaned[5] == ROWS[5][1] and cleaned[7] == ROWS[7][1]
    lost = set(ROWS[23][1].split("\n")) - set(cleaned[23].split("\n"))
    assert len(lost) >= 3 and all(x in ROWS[5][1].split("\n") for x in lost)
    assert cleaned[0] == ROWS[0][1]


def lines_left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.text.split("\n") for r in line_dedup.remove_lines(docs).collect()}


def test_frequent_blocks_go(spark):
    licence = "all rights of this text are with those who wrote it and lent it\nno claim"
    left = lines_left(spark, [f"start {i} here\n{licence}\nend {i} here" for i in range(60)])
    assert len(left[0]) == 4 and all(left[i] == [f"start {i} here", f"end {i} here"] for i in range(1, 60))


def test_partners_hold_the_whole_block(spark):
    left = lines_left(spark, ["x\nq", "y\nr", "x\ns\ny", "y\nx", "a\nx\ny", "b\nx\ny"])
    assert left[4] == ["a", "x", "y"] and left[5] == ["b"]


def brute_lines(texts):
    """Lines with words that lie in a block of two such lines, or of 12 words, of any earlier text."""
    out = []
    for n, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for other in texts[:n]:
            other = other.split("\n")
            for shift in range(-len(lines), len(other)):
                block = []
                for i in range(len(lines) + 1):
                    if i < len(lines) and 0 <= i + shift < len(other) and lines[i] == other[i + shift]:
                        block.append(i)
                        continue
                    sizes = [len(lines[k].split()) for k in block]
                    if sum(s > 0 for s in sizes) >= 2 or sum(sizes) >= 12:
                        gone.update(block)
                    block = []
        out.append([x for i, x in enumerate(lines) if x.strip() and i not in gone])
    return out


def test_line_dedup_against_brute_force(spark):
    draw = random.Random(6)
    pool = [" ".join(draw.choices("abcdefgh", k=draw.choice([1, 2, 5, 11, 12, 13]))) for _ in range(25)] + ["", "", " "]
    texts = ["\n".join(draw.choices(pool, k=draw.randint(1, 9))) for _ in range(80)]
    left = lines_left(spark, texts)
    assert [[x for x in left[i] if x.strip()] for i in range(len(texts))] == brute_lines(texts)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    draw = random.Random(2)
    for _ in range(2000):
        a, b = (draw.choices("abc", k=draw.randint(0, 14)) for _ in range(2))
        most = draw.randint(0, 9)
        exact = edit_distance(a, b)
        assert near_dedup.distance_within(a, b, most) == (exact if exact <= most else None)


def test_near_dedup(docs):
    frame, node, label = near_dedup.classify(docs)
    assert frame.count() == len(ROWS)
    of = {r[0]: r[1] for r in frame.select("doc_id", F.col(f"{label}.doc")).collect()}
    assert of[60] == 7 and of[61] == 9 and of[68] == 2 and of[None] == 4 and of[63] == 62
    assert all(of[i] == i for i in range(60))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (60, 61, 68)").count() == 0


def test_a_large_bucket_loses_nothing(spark):
    draw = random.Random(1)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(4):
            words[draw.randrange(120)] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{draw.randint(0, 10**6)}" for _ in range(60)])) for i in range(60)]
    frame, _, label = near_dedup.classify(spark.createDataFrame(rows, "doc_id bigint, text string"))
    of = {r[0]: r[1] for r in frame.select("doc_id", F.col(f"{label}.doc")).collect()}
    assert all(of[i] == 0 for i in range(150)) and all(of[i] == i for i in range(1000, 1060))


@pytest.mark.parametrize(("chunk", "pairs"), [(256, 1 << 17), (2, 5)])
def test_a_common_passage_hides_no_link(spark, monkeypatch, chunk, pairs):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(60)]
    passage = draw.choices(words, k=30)
    texts = []
    for _ in range(24):
        text = passage + draw.choices(words, k=draw.randint(8, 30))
        texts.append(text)
        if draw.random() < 0.4:
            near = list(text)
            for at in draw.sample(range(len(near)), len(near) // 12):
                near[at] = draw.choice(words)
            texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    label = list(range(len(rows)))
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        a, b = a.split(), b.split()
        if edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    frame, _, found = near_dedup.classify(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.first for r in frame.select("doc_id", F.col(f"{found}.doc").alias("first")).collect()} == dict(enumerate(label))


def test_pairs_to_verify_are_no_rows(spark, monkeypatch):
    """Texts of one passage and the same words pass the sieve with each other: rows stay those of nodes and buckets."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(42)]
    texts = [words[:12] + draw.sample(words[12:], 30) for _ in range(120)]
    near = list(texts[77])
    near[20] = "other"
    texts.append(near)
    seen, keep = [], near_dedup.stored

    def counted(frame):
        seen.append(keep(frame))
        return seen[-1]

    monkeypatch.setattr(near_dedup, "stored", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame, _, label = near_dedup.classify(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.doc_id: r.first for r in frame.select("doc_id", F.col(f"{label}.doc").alias("first")).collect()}
    assert found == {i: 77 if i == 120 else i for i in range(121)}
    assert max(f.count() for f in seen) <= 121 * near_dedup.TIERS[1][4]


def test_pairs_that_failed_are_not_tried_again(spark, monkeypatch):
    """Texts of one passage have one head that none is like: the next round holds them against another."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefgh", k=6))
    passage = [word() for _ in range(30)]
    texts = [passage + [word() for _ in range(30)] for _ in range(40)]
    texts += [[*t[:50], word(), *t[51:]] for t in texts[:10]]
    tried, keep = [], near_dedup.verify

    def counted(pairs, nodes):
        tried.append({(r.u, r.v) for r in pairs.collect()})
        return keep(pairs, nodes)

    monkeypatch.setattr(near_dedup, "verify", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    frame, _, label = near_dedup.classify(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.doc_id: r.first for r in frame.select("doc_id", F.col(f"{label}.doc").alias("first")).collect()}
    assert found == {i: i - 40 if i >= 40 else i for i in range(50)}
    assert len(tried) == 2 and tried[1] and not tried[0] & tried[1]


def test_chunks_of_a_large_bucket_meet_by_length(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    lengths = [10, 10, 12, 12, 13, 40, 41, 50, 51, 63, 64, 64, 400, 500, 501, 900]
    rows = [(i, n, 7) for i, n in enumerate(lengths)] + [(20, 10, 8), (21, 900, 8)]
    open_ = near_dedup.open_rows(spark.createDataFrame(rows, "id bigint, words int, bucket bigint"), None)
    cut = open_.withColumn("mine", F.expr("int((place - 1) div 3)")).withColumn("n", F.col("n").cast("int"))
    met = {(r.bucket, r.mine): set(r.others) for r in near_dedup._meeting_chunks(cut).collect()}
    chunk = {r.id: r.mine for r in cut.where("bucket = 7").collect()}
    near = {(a, b) for a, x in enumerate(lengths) for b, y in enumerate(lengths) if min(x, y) >= 0.8 * max(x, y)}
    assert met == {(7, m): {chunk[b] for a, b in near if chunk[a] == m} for m in range(6)}
    assert sum(map(len, met.values())) < 36


def test_the_first_sieve_loses_no_pair():
    draw = np.random.default_rng(1)
    signs = np.minimum(draw.poisson(draw.choice([0.1, 1, 20, 200], (60, 1)), (60, near_dedup.SIGNS)), 255).astype(np.uint8)
    packed = near_dedup.coarse(signs)
    cells = np.concatenate([packed & 15, packed >> 4], axis=1)
    a, b = (x.ravel() for x in np.indices((60, 60)))
    assert packed.shape == (60, 64) and (near_dedup.least_edits(cells[a], cells[b]) <= near_dedup.least_edits(signs[a], signs[b])).all()


@pytest.mark.parametrize("n", [5, 9, 10, 12, 20, 40, 60, 100, 400])
def test_sketch_recall_at_the_least_similarity(n):
    """Pairs at the least similarity meet in a bucket, edits being spread evenly or at random."""
    draw = random.Random(n)
    for even in (True, False):
        texts = []
        for _ in range(60):
            text = [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
            near = text[:]
            for at in (range(2, n, 5) if even else draw.sample(range(n), n // 5)):
                near[at] = f"x{draw.randint(0, 10**9)}" if at % 5 == 2 or not even else near[at]
            near = near if edit_distance(text, near) <= n // 5 else text
            texts += [" ".join(text).encode(), " ".join(near).encode()]
        _, found, _ = near_dedup.buckets(texts)
        assert np.mean([bool(set(found[i]) & set(found[i + 1])) for i in range(0, 120, 2)]) >= 0.9


def test_texts_of_few_words_and_of_similar_lengths(spark):
    texts = ["a b c d", "a  b c\td", "a b c e", "", " ", "a", "a b", "b a", " ".join("abcdefghijkl"), " ".join("abcdefghijklm")]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (30, 33)] + ["to " * 30000, "to " * 30000 + "go"]
    frame, _, label = near_dedup.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    found = {r[0]: r[1] for r in frame.select("doc_id", F.col(f"{label}.doc")).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 10, 12: 12, 13: 12}


def test_components_of_chains_and_stars(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(300, 301), (301, 300)]
    links += [tuple(draw.sample(range(400, 460), 2)) for _ in range(45)]
    least = {n: n for link in links for n in link}
    for _ in least:
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    found = near_dedup.components(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {r.node: r.label for r in found.collect()} == least


def test_texts_move_once(spark, monkeypatch):
    """Texts are brought to their nodes once; what is kept takes them from there, null ones as null."""
    made, keep = [], near_dedup.stored_by

    def counted(frame, key):
        made.append(frame)
        return keep(frame, key)

    monkeypatch.setattr(near_dedup, "stored_by", counted)
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "a"), (2, long + " x", "b"), (3, None, "c"), (4, "", "d"), (None, "é  ü\n", "e"), (5, long, "f"), (1, long, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `s.t` string")
    kept = near_dedup.keep_one(docs)
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[2]) == [rows[0], rows[2], rows[4]]

    def moved(frame):
        told = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
        return [part for part in told.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", part)]

    nodes = [part for part in moved(made[0].drop("clash")) if "REPARTITION" in part or "ENSURE" in part]
    texts = [part for part in moved(kept) if re.search(r"\btext#|\bfirst#", part.split("Arguments")[0])]
    assert (len(nodes), len(texts)) == (1, 0), (nodes, texts)


def test_near_dedup_of_nothing(nothing):
    assert near_dedup.keep_one(nothing).count() == 0 and near_dedup.classes(nothing).count() == 0


def test_language(spark):
    draw = random.Random(4)
    letters = {"xx": "aeiklmn", "yy": "bdgoprt"}
    say = lambda lang, n: " ".join("".join(draw.choices(letters[lang], k=draw.randint(2, 6))) for _ in range(n))
    rows = [(i, say("xx" if i % 2 else "yy", 40), "xx" if i % 2 else "yy") for i in range(120)]
    rows += [(200, None, "xx"), (201, " 12 -", "yy"), (202, say("xx", 30) + " " + say("yy", 60), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    held = [r for r in rows[:120] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(found[i].lang_pred == lang and found[i].held_out for i, _, lang in held)
    assert found[200].lang_pred == found[201].lang_pred == "und" and found[200].score == 0
    assert found[202].lang_pred == "yy" and [s.lang for s in found[202].spans][0] == "xx"
    cut = found[202].spans[0]
    assert abs(cut.words - 30) <= 2 and all(0 <= r.score <= 1 for r in found.values())


def test_the_sample_is_bounded_and_copies_count_once(spark):
    rows = [("a copied text", "xx")] * 300 + [(f"text {i}", "xx") for i in range(40)] + [(f"word {i}", "yy") for i in range(5)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for sample in (10, 1000):
        languages, _, stretches = language.gather(docs, sample)
        assert languages == ["xx", "yy"] and all(len(set(x)) == len(x) for x in stretches.values())
        assert [len(stretches[x]) for x in languages] == [min(sample, 41), 5]


def test_chains_of_any_length():
    draw = np.random.default_rng(0)
    sizes = np.array([1, 64, 65, 0, 200])
    unary, steps = draw.normal(size=(sizes.sum(), 3)), draw.normal(size=(3, 3))
    whole, at = language.chain_posteriors(unary, sizes, steps), 0
    for n in sizes[sizes > 0]:
        plain, _ = language.forward_backward(unary[None, at : at + n], steps)
        assert np.allclose(plain[0], whole[at : at + n])
        at += n


def test_fingerprints(spark, docs, folder):
    rows = fingerprints.op10_fingerprints(spark, folder).collect()
    order = sorted(((LAST if r[0] is None else -r[0]), r[1] or "") for r in ROWS)
    texts = [t for _, t in order]
    expected = []
    for a, b in zip(texts, [*texts[1:], texts[0]], strict=True):
        new = fingerprints.edited(a, b)
        sets = [set(fingerprints.digests(t)) for t in (a, new, b)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        expected.append((len(a), hashlib.sha256(new.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2])))
    got = [(r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows]
    assert sorted(got) == sorted(expected)
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[60] == prints[7] and len(prints[68]) == 1


def test_sketches_recover_differences():
    draw = random.Random(3)
    common = [draw.getrandbits(64) for _ in range(300)]
    for n in (0, 1, 7, 200):
        a, b = common + [draw.getrandbits(64) for _ in range(n)], common + [draw.getrandbits(64) for _ in range(n // 2)]
        ((mine, theirs),) = fingerprints.differences([a, b], [(0, 1)])
        assert set(mine) == set(a) - set(b) and set(theirs) == set(b) - set(a)


def test_pipeline(spark, docs, folder):
    import corpus_pipeline

    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert [corpus_pipeline.STAGES[i][0] for i in (0, 2)] == ["quality rules", "near dedup"]
    for _, stage in itertools.islice(corpus_pipeline.STAGES, 4):
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
