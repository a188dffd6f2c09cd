"""Token tables, packing, personal data, chat formatting: helpers against brute force, operators on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from indexloom.llm import chat, packing, pii, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, id string, counts int, spans string"
TEXTS = [
    None,
    "",
    " \n\t ",
    "The and attion. Thble!\nmail a.b@mail2.example.com or +1 (619) 555-1368, 10.2.3.44",
    "naïve ÉCOLE <|endoftext|> don't 12 文字",
    "x" * 5000,
    "card 4570364245126885 card 4570364245126886",
    "the same text",
    "the same text",
]


def table(spark, texts=TEXTS):
    rows = [(i if i != 4 else None, t, None, None, None, 1, "a", 2, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]] if rows else [], SCHEMA)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_prefix_counts_are_the_librarys():
    own, draw = tokens.Encoder(PATH), random.Random(1)
    signs = ["a", "the", "ING", " ", "  ", "\n", "'s", "'", "'re", "1", "<|endoftext|>", "<|", "é", "Σ", "İ", "中", "́", "!!", "\xa0"]
    for _ in range(60):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 30)))
        own.learn_tables(set(own.pieces(text)))
        expected = [len(ids(text[:i])) for i in range(len(text) + 1)]
        assert own.prefix_counts(text).tolist() == expected
        assert np.frombuffer(next(own.batch_ids([text])), "<u4").tolist() == ids(text)


def test_long_words_use_the_same_merges():
    own, draw = tokens.Encoder(PATH), random.Random(2)
    word = "".join(draw.choice("etaoinshr") for _ in range(700))
    own.learn_tables({word})
    counts = own.prefix_counts(word)
    assert [counts[i] for i in (0, 1, 300, 699, 700)] == [len(ids(word[:i])) for i in (0, 1, 300, 699, 700)]


def test_token_tables(spark):
    rows = tokens.prefix_tables(table(spark), PATH)
    found = rows.select("doc_id", "n_bytes", tokens.tokens_in(rows.counts).alias("n"), tokens.tokens_in(rows.counts, 3).alias("three"),
                        tokens.chars_within(rows.counts, 2).alias("fits")).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids((r.text or "")[:3])),
                 max(i for i in range(len(r.text or "") + 1) if len(ids((r.text or "")[:i])) <= 2) if len(r.text or "") < 100 else None)
                for r in table(spark).collect()]
    assert sorted(map(repr, [tuple(r)[:4] for r in found])) == sorted(map(repr, [e[:4] for e in expected]))
    assert {(r.doc_id, r.fits) for r in found if r.n_bytes < 100} == {(e[0], e[4]) for e in expected if e[1] < 100}
    assert tokens.prefix_tables(table(spark, []), PATH).count() == 0


def test_windows_are_the_cheapest():
    draw = random.Random(3)
    for _ in range(60):
        gaps = [draw.randint(1, 12) for _ in range(draw.randint(1, 9))]
        places, costs = np.cumsum(gaps), np.array([draw.choice([0, 2, 5]) for _ in gaps])
        window = draw.choice([12, 16, 20])
        at = [0, *places.tolist()]
        best = [0] + [10**9] * len(gaps)
        for j in range(1, len(at)):
            for i in range(j):
                if at[j] - at[i] <= window:
                    best[j] = min(best[j], best[i] + packing.padding(at[j] - at[i], window) + int(costs[j - 1]))
        ends = packing.cut_windows(places, costs, window)
        begins = [0, *ends[:-1]]
        cost = sum(packing.padding(e - b, window) + int(costs[places.tolist().index(e)]) for b, e in zip(begins, ends, strict=True))
        assert ends[-1] == at[-1] and cost == best[-1]


def test_packing_loses_no_id(spark):
    how = packing.Packing(PATH, length=64, stride=16, block=300)
    pieces = packing.pack(table(spark), how).collect()
    assert all(p.length <= 64 and zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32 for p in pieces)
    whole: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        whole.setdefault(p.sequence_id, []).append(p)
    for run in whole.values():
        assert [p.offset for p in run] == [sum(q.length for q in run[:i]) for i in range(len(run))]
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for r in table(spark).collect():
        parts = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        copies = 2 if r.doc_id == 8 else 1
        assert sum(p.length for p in parts) == copies * (len(ids(r.text)) + 1)
        if copies == 1:
            assert [i for p in parts for i in p.ids] == [*ids(r.text), 1]
    assert packing.pack(table(spark, []), how).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    draw = random.Random(4)
    signs = ["a", "b.c", "@", "1", "22", "256", ".", "+", "-", " ", "(", ")", "4570364245126885", "x@y.z", "1.2.3.4", "\n", "é", "00"]
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 50_000, "+1 " * 30_000, "@" * 50_000):
        pii.base_spans(text)


def test_best_segmentation_is_the_best_of_all():
    draw, words = random.Random(5), ["+1 (619) 555-1368", "10.2.3.4", "a.b@c.de"]
    model = pii.train(words * 3)
    ends, found = pii.lattice("+1 555 10.2")
    for _ in range(20):
        model.weights = {f: draw.uniform(-2, 2) for _, _, _, fs in found for f in fs}

        def score(k):
            return sum(model.weights[f] for f in found[k][3])

        def best(at):
            if at == len(ends):
                return 0.0
            options = [score(k) + best(found[k][2]) for k in range(len(found)) if found[k][1] == at]
            return max([best(at + 1), *options])

        assert abs(sum(map(score, model.decode(len(ends), found))) - best(0)) < 1e-9


def test_personal_data(spark):
    rows = {r.doc_id: r for r in pii.find(table(spark)).collect()}
    assert len(rows) == len(TEXTS) and (rows[3].n_email, rows[3].n_ip, rows[3].n_phone, rows[6].n_card) == (1, 1, 1, 1)
    text = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for k, s, e in plain_spans(TEXTS[3]))
    assert rows[3].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(rows[3].spans.split(","))
    clean = {r.doc_id: r for r in pii.redacted(table(spark)).collect()}
    assert clean[0].text is None and clean[7].text == TEXTS[7] and clean[3].spans == "s"
    assert "[EMAIL]" in clean[3].text and "[PHONE]" in clean[3].text and "[IP]" in clean[3].text
    assert pii.find(table(spark, [])).count() == 0


def test_turns_survive_the_round_trip():
    draw = random.Random(6)
    signs = ["###", "### ", "Assistant: ", "\\", "\\\\", "</turn>", "\n", "ok", " ", "%3A;"]
    for _ in range(3000):
        turns = [(draw.choice(["user", "assistant", "User", "", "a: b", "x\ny"]), "".join(draw.choices(signs, k=draw.randint(0, 7)))) for _ in range(3)]
        text = "".join(chat.format_turn(*t) for t in turns)
        read = chat.parse(text)
        assert [(t.role, t.text) for t in read] == turns
        assert all(chat.unescape(text[t.start : t.end]) == t.text for t in read)
    assert chat.parse("### User: no end") is None


def test_conversations(spark):
    rows = [(1, 0, "user", "a", 9), (1, 1, "assistant", "</turn>", 9), (1, 2, None, None, 9), (2, None, "assistant", "b\\", 9), (None, 0, "user", "c", 9), (2, None, "assistant", "b\\", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    parts = chat.with_loss_mask(chat.format_conversations(turns, part_chars=10))
    assert parts.count() > 3
    found = {r.conv_id: r for r in chat.read_back(parts).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1].turns_sha256 == digest("user\na\nassistant\n</turn>\n\n\n") and found[1].loss_sha256 == digest("</turn>")
    assert (found[2].n_turns, found[2].loss_chars, found[None].n_turns, found[None].loss_chars) == (2, 4, 1, 0)
    assert chat.read_back(chat.with_loss_mask(chat.format_conversations(turns.limit(0)))).count() == 0
