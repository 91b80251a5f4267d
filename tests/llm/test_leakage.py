from __future__ import annotations

import random

import pytest

from sonarlake.llm.leakage import Index, Passage, edit_distance, fold, fold_document, leaked_items, leaks
from sonarlake.llm.subtitles import repair, repair_with_ends

DOCS = "doc_id long, text string, item_id long, passage string"
ITEMS = "item_id long, passage string, text string"
SYL = "kel ros gra mun tam pol nel ver fen jin cor lor quil wex dan gar bri fli sen".split()


def words(r, n):
    return ["".join(r.choice(SYL) for _ in range(r.randint(1, 4))) for _ in range(n)]


def cued(ws, r):
    out, i, k = [], 0, 1
    while i < len(ws):
        n = r.randint(3, 8)
        out.append(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n" + " ".join(ws[i : i + n]) + "\n")
        if r.random() < 0.2:
            k += 1
            out.append(f"{k}\n00:00:{k % 60:02d},950 --> 00:00:{k % 60:02d},990\n[door creaks]\n")
        i, k = i + n, k + 1
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_distance_against_table(seed):
    r = random.Random(seed)
    for _ in range(60):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 40)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        bits = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in set(p)}
        assert edit_distance(bits, len(p), t, -1) == min(row)


def test_planted_passages(spark):
    r = random.Random(11)
    items = [(i, " ".join(words(r, 30)).capitalize() + ".", "") for i in range(30)]
    docs, want = [], set()
    for d in range(150):
        ws = words(r, 60)
        if d < 90:
            item = r.randrange(30)
            n, at = (r.choice([12, 13, 20, 30]), 0) if d < 60 else (r.choice([4, 8, 10]), 0)
            part = items[item][1].split()
            at = r.randint(0, 30 - n)
            part = part[at : at + n]
            if d % 4 == 1:
                part = [w.upper() for w in part]
            if d % 4 == 2:
                k = r.randrange(n)
                part[k] = part[k].replace("m", "rn").replace("l", "I").replace("o", "0") + ","
            if d % 4 == 3:
                part[n // 2] = "<i>" + part[n // 2] + "</i>" + "!"
            ws[20:20] = part
            if d < 60:
                want.add((d, item))
        docs.append((d, cued(ws, r), 5, "x"))
    docs += [(500, None, 1, ""), (501, "", 1, ""), (None, items[0][1], 1, ""), (502, items[3][1] * 2000, 1, "")]
    want.add((502, 3))
    got = {tuple(x) for x in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items + items[:3] + [(None, "x", ""), (99, None, ""), (98, "", "")], ITEMS)).collect()}
    assert got == want


def test_scripts_without_blanks(spark):
    r = random.Random(3)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 60)]
    p = "".join(r.choice(han) for _ in range(60))
    noise = lambda n: "".join(r.choice(han) for _ in range(n))
    docs = [(1, noise(50) + p[10:22] + "。\n" + p[22:34] + noise(50), 0, ""), (2, noise(50) + p[10:30] + noise(50), 0, ""), (3, noise(99), 0, "")]
    assert {tuple(x) for x in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, p, "")], ITEMS)).collect()} == {(1, 7)}


def test_wrong_encodings():
    s = "schön über Straße – “größer” кот 中文"
    once = s.encode().decode("latin-1")
    assert repair(once) == s and repair(once.encode().decode("latin-1")) == s and repair(s) == s
    good, ends = repair_with_ends("ab " + "ü!".encode().decode("latin-1"))
    assert good == "ab ü!" and ends == [1, 2, 3, 5, 6]
    assert fold_document("Gro�!")[0] == fold("gro", True)


def test_blocks_of_items(spark, monkeypatch):
    from sonarlake.llm import leakage

    r = random.Random(5)
    items = [(i, " ".join(words(r, 15)), "") for i in range(9)]
    docs = spark.createDataFrame([(i, items[i][1], 0, "") for i in range(9)], DOCS)
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 3)
    assert {tuple(x) for x in leaks(docs, spark.createDataFrame(items, ITEMS)).collect()} == {(i, i) for i in range(9)}
    assert leaks(docs.limit(0), spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_short_passage_must_be_whole():
    p = Passage(1, "kel ros gra", False, 12, 24, 4)
    assert [w[:3] for w in p.windows] == [(0, len(fold("kelrosgra")), 0)]


def test_one_lost_character_loses_no_script(spark):
    r = random.Random(8)
    for item, letters, gap in ((1, "абвгдежзиклмнопрст", " "), (2, "".join(map(chr, range(0x4E00, 0x4E3C))), "")):
        noise = lambda n: gap.join("".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(n))  # noqa: B023, E731
        p = noise(20)
        docs = [(1, noise(30) + "\n" + p + "\n" + noise(30) + " Gr\ufffd", 0, ""), (2, noise(30) + "\n" + p[:50] + "\ufffd" + p[51:] + "\n" + noise(30), 0, ""), (3, noise(80) + "\ufffd", 0, "")]
        assert sorted(map(tuple, leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(item, p, "")], ITEMS)).collect())) == [(1, item), (2, item)]


def test_brackets_hide_nothing(spark):
    r = random.Random(21)
    items = [(1, "kel (ros gra) " + " ".join(words(r, 16)), ""), (2, " ".join(words(r, 18)), ""), (3, " ".join(words(r, 18)), ""), (4, " ".join(words(r, 18)), "")]
    noise = lambda n: " ".join(words(r, n))
    cut = items[3][1].split()
    docs = [
        (1, f"{noise(40)}\n{items[0][1]}\n{noise(40)}", 0, ""), (2, f"{noise(40)}\n({items[1][1]})\n{noise(40)}", 0, ""), (3, f"{noise(40)} :(\n{items[2][1]}\n:) {noise(40)}", 0, ""),
        (4, f"{noise(40)}\n{' '.join(cut[:9])}\n[door creaks]\n{' '.join(cut[9:])}\n{noise(40)}", 0, ""), (5, f"{noise(40)} ({noise(30)}", 0, ""),
    ]
    assert sorted(map(tuple, leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect())) == [(1, 1), (2, 2), (3, 3), (4, 4)]


@pytest.mark.parametrize("size", [3, 5, 8])
def test_budget_of_edits(size):
    r = random.Random(size)
    abc = "abcdfghjklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(abc) for _ in range(size))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(200)]
    index = Index(items, 12, 24, 4)
    found = 0
    for i, text in items:
        letters = list(text)
        for at in r.sample([j for j, c in enumerate(letters) if c != " "], 4):
            letters[at] = r.choice(["", r.choice(abc), letters[at] + r.choice(abc)])
        found += i in leaked_items(" ".join(word() for _ in range(30)) + " " + "".join(letters) + " " + " ".join(word() for _ in range(30)), index)
    assert found >= 0.95 * 200


def test_budget_without_blanks():
    r = random.Random(4)
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    items = [(i, "".join(r.choice(han) for _ in range(24))) for i in range(200)]
    index = Index(items, 12, 24, 4)
    found = 0
    for i, text in items:
        letters = list(text)
        for at in r.sample(range(24), 3):
            letters[at] = r.choice(["", r.choice(han)])
        found += i in leaked_items("".join(r.choice(han) for _ in range(60)) + "".join(letters) + "".join(r.choice(han) for _ in range(60)), index)
    assert found >= 0.95 * 200
