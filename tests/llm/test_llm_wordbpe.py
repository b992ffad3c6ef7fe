import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from odd import documents, odd_rows
from tokenizers import Tokenizer

from gleaner.llm.pretokens import UNSETTLED, byte_signs
from gleaner.llm.queries import op12_bpe_codec
from gleaner.llm.wordbpe import WordBPE, decoded, encoded, encoding_digest

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return WordBPE.of_file(PATH)


def ids_of(bpe, text):
    return [i for w in bpe.pretokens(text) for i in ([w] if isinstance(w, int) else bpe.merge(w))]


def test_ids_and_text_equal_the_library(library, bpe):
    rng = random.Random(5)
    signs = ["a", "b", "the", "ing", " ", "  ", "\t", "\n", "'s", "'", "é", "é", "ΑΣ", "İ", "ß", "漢", "字", "👍",
             "1", "23", "٣", "½", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "\u0085", " ",
             " ", "\x1c", "\x00", "Ǆ", "꟎", "\U00018d09", ".", ",!", "-", "ﬁ", "K", "QX", "zz"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "=" * 4097, " " * 99, "", "<|endoftext|><|endoftext|>",
              "".join(rng.choice("abcdefghij") for _ in range(20_000)),
              "".join(chr(rng.choice([rng.randint(1, 0xd7ff), rng.randint(0xe000, 0x10ffff)])) for _ in range(3000))]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids_of(bpe, text) == want.ids, repr(text)
        words = [w for w in bpe.pretokens(text) if isinstance(w, str)]
        assert bpe.merge_many(words) == [np.array(bpe.merge(w), dtype="<u4").tobytes() for w in words]
        assert bpe.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_each_settled_sign_is_cut_as_in_the_library(library, bpe):
    _, cut, _ = bpe._parts
    for c in map(chr, range(0x110000)):
        if 0xd800 <= ord(c) < 0xe000 or UNSETTLED.search(c):
            continue
        text = f"a{c}{c}1{c}-{c}"
        want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert cut(text) == want, hex(ord(c))


def test_bytes_have_the_signs_of_the_vocabulary(bpe):
    assert len(set(byte_signs())) == 256
    assert [bpe.tokens[i] for i in bpe.first] == byte_signs()


def test_trees_side_by_side_equal_single_ones(bpe):
    rng = random.Random(11)
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, longest)))
             for signs in ("etaoinshrdlu", "ab", "éüñß漢👍a", "0123456789=-") for longest in (3, 9, 17, 40, 90)
             for _ in range(400)]
    assert bpe.merge_many(words) == [np.array(bpe.merge(w), dtype="<u4").tobytes() for w in words]
    assert bpe.merge_many([]) == []


def test_long_unbroken_text_takes_n_log_n(bpe):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    times = []
    for n in (50_000, 400_000):
        start = time.process_time()
        bpe.merge(text[:n])
        times.append(time.process_time() - start)
    assert times[1] < 24 * max(times[0], 0.05)          # 64 times would be quadratic


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        WordBPE.of_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_odd_documents(spark, library):
    rows = odd_rows([(7, "it's <|endoftext|> THE end</w>", "c")])
    got = encoding_digest(decoded(encoded(documents(spark, rows), PATH), PATH)).collect()

    def line(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return (str(doc_id), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(line(d, t) for d, t, _ in rows)
    assert decoded(encoded(documents(spark, []), PATH), PATH).count() == 0
    extra = encoded(documents(spark, rows), PATH, keep=("doc_id", "digest")).collect()
    assert {r["digest"] for r in extra} == {"x"}


def test_query_over_the_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op12_bpe_codec(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(
            library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
