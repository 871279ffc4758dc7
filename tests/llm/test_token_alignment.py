import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veriframe.llm import token_alignment
from veriframe.llm.queries import QUERIES

LEFT = public_tokenizers.path("byte_bpe_50k.json")
RIGHT = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces   three "), (5, "tab\tand\nline \n mixed\r\n"), (6, "don't we'll I'M 12345 a1b2"), (7, "naïve ÉCOLE Σίσυφος"),
    (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (9, "日本語 テキスト emoji 😀😀  nbsp em"), (10, "x" * 5000), (11, "a ▁ b"), (12, "word " * 6000), (1, None),
    (12, "word " * 6000), (None, "no id"), (13, "é a ̈ b"), (14, "\x1c \x1fcontrol \x85 next\n"), (15, "nul\x00 in"), (16, "two words"), (16, "other words"),
]


def brute(rows):
    """The contract, pair by pair."""
    a_model = Tokenizer.from_file(LEFT)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    left = token_alignment.ByteLevelFile.read(LEFT).token_bytes()
    out, pairs = [], Counter()
    for doc_id, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        right = [bytes([int(p[3:-1], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(left[i] for i in a) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            a, b, right = [], [], []
        ends_a, ends_b = np.cumsum([len(left[i]) for i in a]).tolist(), np.cumsum([len(p) for p in right]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, links = [], []
        at_a = at_b = 0
        for end in common:
            next_a, next_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            own_a, own_b = a[at_a:next_a], b[at_b:next_b]
            at_a, at_b = next_a, next_b
            groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            links.append((own_a[-1], own_b[-1]))
        pairs.update(links)
        out.append((doc_id, len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (_, b), n in pairs.items():
        highest[b] = max(highest[b], n)
    return Counter(
        (doc_id, n_a, n_b, len(groups), len(links), sum(pairs[x] == highest[x[1]] for x in links), sum(pairs[x] for x in links), ";".join(groups))
        for doc_id, n_a, n_b, groups, links in out
    )


def got(rows):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r[7]) for r in rows)


def files():
    return token_alignment.ByteLevelFile.read(LEFT), token_alignment.PieceModel.read(RIGHT)


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_odd_texts(frame, block_bytes):
    docs = frame([r for r in ODD if len(r[1] or "") < 1000 or block_bytes > 1], "1 as block").selectExpr("*", "2 as pairs", "3 as n_a")
    rows = token_alignment.align(docs, *files(), block_bytes=block_bytes).collect()
    assert got(rows) == brute([r for r in ODD if len(r[1] or "") < 1000 or block_bytes > 1])


def test_query(spark, documents):
    rows = QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(list(zip(documents.doc_id, documents.text))).elements())
    assert got(rows.collect()) == want


def test_empty_table_and_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "one two")], "doc_id string, text string")
    assert token_alignment.align(docs.where("false"), *files()).count() == 0
    rows = token_alignment.align(docs, *files()).collect()
    assert {r.doc_id for r in rows} == {"a", None} and all(r.count_sum == 2 * r.n_links for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.booleans())
def test_common_ends(left, right, same):
    left, right = (sorted(x | {61}) for x in (left, left if same else right))
    at_a, at_b = token_alignment.common_ends(np.array(left), np.array(right))
    common = sorted(set(left) & set(right))
    assert [left[i] for i in at_a] == common == [right[j] for j in at_b]


def test_common_ends_of_long_runs():
    shared = np.arange(1, 100_001) * 3
    left, right = np.sort(np.append(shared, [5, 299_999 - 60])), np.sort(np.append(shared, [7, 8, 150_001]))
    at_a, at_b = token_alignment.common_ends(left, right)
    assert (left[at_a] == shared).all() and (right[at_b] == shared).all()
    assert [len(x) for x in token_alignment.common_ends(shared[:0], shared[:0])] == [0, 0]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\t \u2028\x1c▁é日<s>0.\x85"), max_size=14))
def test_stretches_give_the_ids_of_the_whole_text(text):
    left, right = files_coded()
    a_model, b_model, coders = left
    words = token_alignment.stretches(text)
    assert " ".join(words) == text
    if not text or "▁" in text:  # that mark reads as a space, so such a text has no tokens
        return
    assert [i for ids in right[0](words) for i in ids] == a_model.encode(" " + text, add_special_tokens=False).ids
    assert [i for ids in right[1](words) for i in ids] == b_model.encode(text)


_CODED = []


def files_coded():
    if not _CODED:
        a_model = Tokenizer.from_file(LEFT)
        a_model.encode_special_tokens = True
        _CODED.append(((a_model, sentencepiece.SentencePieceProcessor(model_file=RIGHT), None), tuple(f.encoder() for f in files())))
    return _CODED[0]
