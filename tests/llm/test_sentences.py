"""Sentences of hand-marked texts (| stands between sentences) and of dirty ones."""

import re

import numpy as np
import pytest

from strataq.llm import sentences as S

# each line: sentences of one paragraph, separated by |
MARKED = """
Dr. Lokamo reviewed No. 109 and found a partial manifest.|The target took approx. 6.42 s on 192.0.2.225 and 16.88 s elsewhere.|Who calls policy.countFolder()?
The log asks "Who are you?" before the bucket is read.|main.go holds the list of stale names.|The reviewer wrote "Stop. Wait for timber. Then go." under the diff.
The stream (it is raw!) stays in saddle.|(See core/metric.ts for the legacy case.)|The error says "target is shared."|The window is nested, and nobody knows why…|Mr. Zuvolu and Ms. Gokena own it.
It covers routes, guards, stores, etc.|The ledger loads, waits ... and then fails in lib.rs.|Why does hollow import wrangler.toml twice?!|Use a pending window, e.g. the one in go.mod.
Am 21. März wurde meadow umbenannt.|Nutze z. B. session.splitVector() statt einer Kopie.|Die Prüfung fragt „Wer bist du?“ und wartet auf loom.|Der Ordner enthält Routen, Speicher usw.|Der Wert ist leer, d. h. cinder fehlt.
El aviso dice «¿Seguro? Piensa en sable.» y espera.|La carpeta guarda rutas, permisos, etc.|¡No borres go.mod!|La Sra. Kanava revisó el n.º 632 de harbor.
Ne supprimez pas routes.ts !|Le contrôle demande « Qui êtes-vous ? » avant de lire cobalt.|Utilisez p. ex. payload.writeSnapshot() au lieu d’une copie.
Папка quarry хранит пути, ключи и т. д.|Значение пусто, т. е. beacon не прочитан.|См. рис. 304 и разд. 37.72 про gantry.|Сообщение «Кто вы?» появляется перед cinder.
Ποιος καλεί το session.storeHeader();|Μην σβήσεις το main.go!|Η πύλη οδηγεί στο hollow, π.χ. μέσω formatPartialBranch.
""".strip().split("\n")
TIGHT = [
    "日志写着“你是谁？请登录。”，然后等待cobalt。|谁在调用payload.collectLedger()？|除了ridge，没有人导入Cargo.toml……|请不要删除schema.prisma！",
    "画面に「誰ですか。入力してください。」と出てrafterを待ちます。|lib.rsを消さないでください！|app.pyの読み込みには約5.84秒かかります。",
]

THAI = ["อย่าลบแฟ้มนี้ก่อนตรวจสอบ", "โฟลเดอร์ gantry เก็บเส้นทางและตัวตรวจ", "โมดูล quill อ่าน 706 บรรทัดจากแฟ้ม", "การอ่านใช้เวลา 31.44 วินาทีโดยประมาณ"]


def corpus():
    """The marked sentences shuffled into many paragraphs, as the model learns from the corpus it splits."""
    import random

    rnd = random.Random(3)
    docs = []
    for line in MARKED + TIGHT:
        parts = line.split("|")
        for _ in range(60):
            docs.append("\n\n".join((" " if line in MARKED else "").join(rnd.choices(parts, k=rnd.randrange(1, 5))) for _ in range(3)))
    for _ in range(60):
        docs.append("\n\n".join(" ".join(rnd.choices(THAI, k=rnd.randrange(1, 4))) + rnd.choice(["", "", "!"]) for _ in range(3)))
    return docs


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(spark.createDataFrame(list(enumerate(corpus())), "doc_id bigint, text string"))


@pytest.mark.parametrize("line", MARKED + TIGHT)
def test_marked(model, line):
    text = line.replace("|", " " if line in MARKED else "")
    assert [text[a:b] for a, b in S.split(text, model)] == line.split("|")
    wrapped = re.sub(r"(\S{3,} \S+ \S+) ", r"\1\r\n", text)
    assert [re.sub(r"\s+", " ", wrapped[a:b]) for a, b in S.split(wrapped, model)] == line.split("|")


def test_blocks(model):
    text = "﻿# 1.2 A heading. With two\n\nOne\nline? Two.\n- first item. It goes\n  on here.\n- second\n1. third\n2. fourth\n```py\nNo. Not this.\n```\nlast one on the\n12. of May\n\n \n## \n"
    got = [text[a:b] for a, b in S.split(text, model)]
    assert got == ["1.2 A heading. With two", "One\nline?", "Two.", "first item.", "It goes\n  on here.", "second", "third", "fourth", "last one on the\n12. of May"]
    assert [S.split(t, model) for t in ("", " \r\n\t", "﻿", "```\nx. y", "no mark")] == [[], [], [], [], [(0, 7)]]
    thai = "อย่าลบแฟ้มนี้ก่อนตรวจสอบ โฟลเดอร์ gantry เก็บเส้นทางและตัวตรวจ"
    assert [thai[a:b] for a, b in S.split(thai, model)] == ["อย่าลบแฟ้มนี้ก่อนตรวจสอบ", "โฟลเดอร์ gantry เก็บเส้นทางและตัวตรวจ"]


def test_dirty(spark, model):
    long = "A short one. " * 20_000
    rows = [(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, ""), (None, "X."), (4, long), (5, "(" * 10_000 + "." * 10_000), (6, "😀 Up. \U0001d538 x.")]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id bigint, text string, end_pos int")
    out = S.sentences(df, model).distinct().collect()
    assert sum(r.doc_id == 4 for r in out) == 20_000
    assert {(r.start_pos, r.end_pos) for r in out if r.doc_id == 6} == {(0, 5), (6, 10)}
    assert S.sentences(df.limit(0)).count() == 0


def test_one_case(model):
    text = MARKED[0].split("|")[0].lower() + " " + "it covers routes, guards, stores, etc. the ledger loads and stops."
    assert [text[a:b] for a, b in S.split(text, model)][1:] == ["it covers routes, guards, stores, etc.", "the ledger loads and stops."]


@pytest.mark.parametrize("quote", ["„{}“", "«{}»", "({})", '"{}"'])
def test_long_quotation_does_not_divide(quote):
    text = "The log asks " + quote.format("Who are you? Wait for timber. " * 30 + "Then go.") + " before the bucket is read."
    assert not [p for p in S._places(text) if p.end < text.index(" before")]


def test_deep_and_unpaired_brackets():
    deep = "(" + "[(" * 40 + "x" + ")]" * 40 + ")"
    assert len(S._shields(deep)) == 81
    assert S._shields('a 5" b. "c. ' + "d. " * 200 + '"e. f."')[-1][0] > 500


def test_viterbi_weighs_what_stands_beside():
    places = [S._Place(n, None, ("latin", "latin"), "", "space", False) for n in (10, 12, 40)]
    weights = {S._slot("space=latin|latin"): 0.5}
    alone = S.Model(weights, [[[0.0, 0.0], [0.0, 0.0]]] * 2, frozenset())
    chained = S.Model(weights, [[[0.0, 0.0], [0.0, -2.0]], [[0.0, 0.0], [0.0, 0.0]]], frozenset())
    assert [alone.score(p) > 0 for p in places] == alone.tags(places) == [True, True, True]
    assert chained.tags(places) in ([True, False, True], [False, True, True])


def test_chain_learns_its_transitions():
    """Two places close together of which the labels never make both a boundary; the features tell them nothing apart."""
    rng = np.random.default_rng(1)
    one = rng.random(400) < 0.5
    labels = [[1, 0, 1] if x else [0, 1, 1] for x in one]
    weights, steps = S._chain([[7, 7, 7]] * 400, [[1, 1, 1]] * 400, [[1, 0, 1]] * 400, labels, np.ones(400))
    steps = np.array(steps)
    assert steps[0, 1, 0] > steps[0, 1, 1] + 0.5 and steps[0, 0, 1] + weights[7] > steps[0, 0, 0] + 0.5
    assert S._chain([], [], [], [], np.ones(0))[0] == {}


def test_thai_is_learned_with_both_labels(model):
    thai, beside = (S._Place(9, None, form, "", "space", False) for form in (("thai", "thai"), ("thai", "latin")))
    assert model.score(thai) > 0 > model.score(beside) and model.score(S._Place(9, None, ("digit", "thai"), "", "space", False)) < 0
    text = " ".join(THAI)
    assert [text[a:b] for a, b in S.split(text, model)] == THAI


def test_words_after_ordinals_are_counted(spark):
    docs = [f"Am {n % 28 + 1}. März kam es. Der Rest blieb.\n\nDer Ordner ist leer. Um 12. Der Rest." for n in range(40)]
    found = S.fit(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    assert found.ordinals == {"märz"}
