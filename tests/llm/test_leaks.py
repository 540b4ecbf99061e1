"""Leaks against a comparison of every window of every item with every place of every text."""

import random

from strataq.llm import leaks


def brute(docs, items):
    shared = {}
    for i, t in items:
        for s in leaks._SENTENCE.split(t or ""):
            shared.setdefault(tuple(leaks.words(s)), set()).add(i)
    out = set()
    for i, t in items:
        if not t:
            continue
        han = leaks._is_han(t)
        own = []
        for s in leaks._SENTENCE.split(t):
            w = leaks.words(s)
            c = list("".join(w)) if han else w
            own += [None if len(shared[tuple(w)]) > 1 and len(c) >= leaks.SHARED_TOKENS else x for x in c]
        least = 20 if han else 12
        for d, text in docs:
            w = leaks.words(text or "")
            w = "".join(w) if han else w
            for a in range(len(own)):
                for b in range(len(w)):
                    bad = n = 0
                    while a + n < len(own) and b + n < len(w) and own[a + n] is not None:
                        bad += own[a + n] != w[b + n]
                        n += 1
                        if (han and bad) or (n == 1 and bad):
                            break
                        if n >= least and bad * 5 <= n and own[a + n - 1] == w[b + n - 1]:
                            out.add((i, d))
                            break
    return out


def test_leaks(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rule = "Read this short general notice before you answer any of them."
    items = [(i, rule + " " + " ".join(rnd.choices(vocabulary, k=40)) + ".") for i in range(8)]
    han = "".join(chr(0x4E00 + i) for i in range(50))
    items += [(20, "".join(rnd.choices(han, k=60)) + "。"), (21, None), (22, ""), (23, "too short")]
    docs = []
    for d in range(120):
        i, text = rnd.choice(items[:9])
        if i == 20:
            start, n = rnd.randrange(30), rnd.choice([19, 20, 21, 30])
            passage = "，".join(text[start : start + n])
        else:
            w = text.split()[12:]
            n = rnd.choice([10, 11, 12, 13, 15, 16, 20, 25])
            start = rnd.randrange(len(w) - n)
            w = w[start : start + n]
            for at in rnd.sample(range(n), rnd.choice([0, 1, n // 5, n // 5, n // 4, n // 3])):
                w[at] = "other" + str(rnd.randrange(9))
            passage = rnd.choice([" ", "\n> ", ", ", "&nbsp;", " **", "​ "]).join(w).upper()
        docs.append((d, " ".join(rnd.choices(vocabulary, k=10)) + " " + passage + " " + " ".join(rnd.choices(vocabulary, k=10))))
    docs += [(500, rule * 3), (501, None), (502, ""), (503, items[0][1] + "x" * 50_000), (503, items[0][1]), (504, "soft­ly " + items[1][1].replace("w", "w‍"))]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id bigint, text string, doc_id string")
    got = leaks.leaks(df, q.select("item_id", "text"))
    rows = [(r.item_id, r.doc_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items)
    assert {(0, 503), (1, 504)} <= set(rows) and not any(d == 500 for _, d in rows)
    assert leaks.leaks(df.limit(0), q).count() == 0 and leaks.leaks(df, q.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}n{k}" for k in range(14))) for i in range(5)]
    q = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame([(i, "so " + t) for i, t in items], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    assert sorted((r.item_id, r.doc_id) for r in leaks.leaks(df, q).collect()) == [(i, i) for i in range(5)]
