import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd import documents, odd_rows
from tokenizers import Tokenizer

from gleaner.llm import aligned
from gleaner.llm.aligned import Aligned, ByteLevel, Pair, Pieces, alignments
from gleaner.llm.pretokens import UNSETTLED, byte_signs
from gleaner.llm.queries import op13_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(texts):
    """Rows in the order of `texts`, by sets of end offsets and loops over all links."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {s: n for n, s in enumerate(byte_signs())}

    def spelled_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs = []
    for text in texts:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            sa = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
            sb = [spelled_b(i) for i in ib]
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                ends = []
                for ids, spelled in ((ia, sa), (ib, sb)):
                    at, own = 0, []
                    for i, s in zip(ids, spelled):
                        at += len(s)
                        own.append((at, i))
                    ends.append(own)
                shared = {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
                cut = [[[]], [[]]]
                for own, out in zip(ends, cut):
                    for e, i in own:
                        out[-1].append(i)
                        if e in shared:
                            out.append([])
                groups = [g for g in zip(*cut) if g[0]]
        docs.append(groups)
    count = Counter()
    for groups in docs:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                     sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                     hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows


def texts_of(seed, n, signs=("a", "the", "ing", " ", "  ", "\n", "'s", "é", "漢字", "👍", "12", "▁", "-", "==", "<|endoftext|>",
                             "</s>", "word", "Word", ".", "\x00")):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    texts = [*texts_of(1, 400), "-" * 999, "=" * 333 + "é" * 100, "a" * 2000, "▁", None, "", "the end", "the end"]
    rows = documents(spark, [(n, t) for n, t in enumerate(texts)]).repartition(3)
    want = dict(enumerate(brute_force(texts)))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignments(rows, A, B).collect()}
    assert got == want
    # small chunks and steps, so that documents are cut over several chunks
    monkeypatch.setattr(aligned, "CHUNK", 7)
    monkeypatch.setattr(aligned, "STEP_CHARS", 200)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignments(rows, A, B).collect()}
    assert got == want


def test_groups_read_back_as_both_token_sequences(spark):
    texts = texts_of(2, 60)
    pair = Pair(ByteLevel.of_file(A), Pieces.of_file(B))
    for r in alignments(documents(spark, list(enumerate(texts))), A, B, with_groups=True).collect():
        spelled = [[], []]
        for group in filter(None, r["groups"].split(";")):
            sides = [[int(i) for i in ids.split(",")] for ids in group.split("|")]
            assert b"".join(pair.a.spell[i] for i in sides[0]) == b"".join(pair.b.spell[i] for i in sides[1])
            spelled[0] += sides[0]
            spelled[1] += sides[1]
        assert (len(spelled[0]), len(spelled[1])) == (r["n_a"], r["n_b"])
        if r["n_a"]:
            assert b"".join(pair.a.spell[i] for i in spelled[0]).decode() == " " + texts[r["doc_id"]]


def test_a_group_without_shared_ends_is_not_written_out():
    class Sides:                          # ids of 1 and 2 bytes, and of 2 and 1
        _parts = (np.array([1, 2]), np.array([2, 1]), ["0,", "1,", "0|", "1|", "0,", "1,", "0;", "1;"])

    made = Aligned(Sides, [0], [np.array([0] + [1] * 1000)], [np.array([0] * 1000 + [1])])
    assert (made.n_groups.tolist(), made.n_links.tolist()) == ([1], [1001 * 1001])
    entries = [(k, t) for _, key, times in made.entries(10**6) for k, t in zip(key.tolist(), times.tolist())]
    assert entries == [(0, 1000), (1, 1), (2, 1_000_000), (3, 1000)]


def test_each_settled_sign_is_encoded_as_in_the_library():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    signs = [chr(c) for c in range(0x110000) if not 0xd800 <= c < 0xe000 and not UNSETTLED.search(chr(c))]
    texts = [f"a{c}{c}1{c}-{c} {c}  {c}" for c in signs]
    texts += texts_of(3, 500, signs[:2000]) + texts_of(4, 500, [*"etaoin shrdlu  ETAOIN.,'s"]) + ["\ue000 private", " "]
    side = ByteLevel.of_file(A)
    assert side.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_documents(spark):
    rows = odd_rows()
    got = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in
                 alignments(documents(spark, rows), A, B).collect())
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, brute_force([r[1] for r in rows])))
    assert alignments(documents(spark, []), A, B).count() == 0
    assert [tuple(r) for r in alignments(documents(spark, [(1, None), (2, "")]), A, B).orderBy("doc_id").collect()] == [
        (d, 0, 0, 0, 0, 0, 0, "") for d in (1, 2)]


def test_unknown_kinds_are_refused():
    with pytest.raises(ValueError):
        ByteLevel.of_file(public_tokenizers.path("word_bpe_49k.json"))


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, brute_force([d["text"] for d in docs]))}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op13_token_alignment(spark, folder).collect()} == want
