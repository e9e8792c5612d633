import random

import numpy as np
import pytest

from callweave.llm import encoding as E

CLEAN = {
    "en": "The keeper’s café had a naïve plan — “quite enough”, they said… at £40 each during the long winter",
    "de": "Während des Streiks der Schlösser zählt ein höflicher Gast die leeren Fässer für die Küche über der Brücke",
    "es": "El señor de la montaña espera una mano de pintura añil después de la inundación según el año pasado",
    "pt": "A comissão das águas guarda as cartas com atenção até o chão da estação fria então não há dúvida",
    "pl": "Północny skład węgla stracił połowę ciężaru przy rampie załadunkowej później świeżą farbę główny żuraw",
    "ru": "Деревенский хор нашёл дорогу короче после наводнения тихий покупатель попросил второй ключ за городской стеной",
}
DECOYS = ["SÃO JOÃO, ÂNGULO DA PRAÇA", "A ÁREA É SÃ,.", "25 °C ± 2", "© §4 ¶2", "½ m² √2 ≈ 1", "├── a", "ðæt æther þorn", "FORÊT ÊTRE", "🙂 ok", "НОЧНОЙ ПЕКАРЬ"]


def corpus(n=600):
    rnd = random.Random(4)
    out = []
    for _ in range(n):
        lang = rnd.choice(list(CLEAN))
        w = CLEAN[lang].split()
        rnd.shuffle(w)
        out.append(" ".join(w[: rnd.randrange(6, len(w) + 1)]))
    return out


def spoil(text, wrong, right):
    return text.encode(right).decode(wrong)


def test_found_and_restored(spark):
    texts = corpus()
    rows = list(enumerate(texts)) + [(1000 + i, f"{texts[i]} {x}") for i, x in enumerate(DECOYS)]
    spoiled = {}
    for i, (lang, wrong, right) in enumerate([
        ("de", "latin-1", "utf-8"), ("es", "latin-1", "utf-8"), ("ru", "cp1251", "koi8-r"), ("ru", "latin-1", "cp1251"), ("ru", "cp866", "cp1251"),
        ("pl", "cp1252", "cp1250"), ("pt", "mac-roman", "utf-8"), ("de", "cp437", "utf-8"), ("pt", "latin-1", "utf-8"),
    ]):
        spoiled[2000 + i] = (spoil(CLEAN[lang], wrong, right), CLEAN[lang])
    twice = spoil(spoil(CLEAN["es"], "latin-1", "utf-8"), "latin-1", "utf-8")
    spoiled[2100] = (twice, CLEAN["es"])
    spoiled[2101] = ("a plain text and then the cafÃ© at last", "a plain text and then the café at last")
    rows += [(k, v[0]) for k, v in spoiled.items()] + [(2**62 + 1, spoiled[2101][0]), (None, spoiled[2101][0]), (3000, "lost ca� here"), (3001, None), (3002, ""), (3003, "x" * 200_000 + " é"), (2101, spoiled[2101][0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, chain string")
    got = E.find_garbled(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [*spoiled, 2101, 3000, 2**62 + 1, None]))
    spoiled |= {2**62 + 1: spoiled[2101], None: spoiled[2101]}
    for r in got:
        if r["doc_id"] in spoiled:
            assert r["restored"] == spoiled[r["doc_id"]][1] and r["complete"]
        else:
            assert not r["complete"] and r["chain"] == ""
    assert E.find_garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrong", ["latin-1", "mac-roman", "cp437"])
def test_round_trip(wrong):
    for text in ("café", "żółw", "€5 – “x”", "да", "🙂"):
        assert E.undo_utf8(spoil(text, wrong, "utf-8"), wrong) == text
    assert E.undo_utf8("plain", wrong) is None
    assert E.undo_legacy("íîâîå", "latin-1", "cp1251") == "новое"


def test_clean_signs():
    assert all(E.structurally_clean(t) for t in CLEAN.values()) and all(E.structurally_clean(t) for t in ("", "plain"))
    assert not any(E.structurally_clean(t) for t in ("cafÃ© fÃ¼r", "lost �", "íîâîå", "po³owê", "x\x80"))


def test_signs_only(spark):
    """Texts whose only garbled characters are quotes, dashes and the like."""
    signs = "The keeper’s “quite enough”, they said… the keeper’s winter — “quite"
    wrong = {w: spoil(signs, w, "cp1252") for w in ("cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman")}
    wrong = {w: t for w, t in wrong.items() if t != signs}
    assert len(wrong) == 5
    rows = list(enumerate(corpus())) + [(1000 + i, t) for i, t in enumerate(wrong.values())]
    got = {r["doc_id"]: r["restored"] for r in E.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1000 + i: signs for i in range(len(wrong))}


def test_every_pair_of_sets(spark):
    """Texts written in Mac Roman or a DOS set and read with another one."""
    singles = [c for c in E.chains() if c[1] != "utf-8"]
    assert len(singles) == len(set(singles)) == len(E.WRONG) * (len(E.WRONG) - 1)
    spoiled = [(spoil(CLEAN[lang], "cp1251", right), CLEAN[lang]) for right in ("mac-roman", "cp437", "cp850") for lang in ("es", "de")]
    rows = list(enumerate(corpus())) + [(1000 + i, s) for i, (s, _) in enumerate(spoiled)]
    got = {r["doc_id"]: r["restored"] for r in E.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1000 + i: t for i, (_, t) in enumerate(spoiled)}


def test_one_word_of_each_chain(spark):
    """A single garbled word in a sentence, for each single-byte chain that leaves a word without controls."""
    words = sorted({w for t in CLEAN.values() for w in t.split() if not w.isascii() and len(w) > 3 and w.isalpha()})
    spoiled = []
    for wrong, right in (c for c in E.chains() if c[1] != "utf-8"):
        for w in words:
            try:
                bad = spoil(w, wrong, right)
            except UnicodeError:
                continue
            if bad != w and not E._C1.search(bad) and " " not in bad and "\xa0" not in bad:
                spoiled.append((f"they said {bad} during winter", f"they said {w} during winter"))
                break
    assert len(spoiled) > 70
    rows = list(enumerate(corpus(1500))) + [(5000 + i, s) for i, (s, _) in enumerate(spoiled)]
    got = {r["doc_id"]: r["restored"] for r in E.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {5000 + i: t for i, (_, t) in enumerate(spoiled)}


def test_margin_of_all_distinct_texts(spark):
    """Copies count once, and the margin follows the bins: no floor, no fixed number of rows."""
    assert E.validated_margin([]) == float("inf")
    assert E.validated_margin([(0, 9995), (80, 5)]) == 0
    assert E.validated_margin([(0, 9000), (80, 1000)]) == 1.25 * 80 * E.BIN
    texts = corpus(300)
    df = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").where("text is not null")
    counted = E.count_clean(df.select("text"))
    n = counted.where("kind = 'text' and word = 'a'").first()["hits"]
    assert n == sum(not t.isascii() for t in texts)
    trained = spark.sparkContext.broadcast((E.train(counted).counts, *E.known_words(counted)))
    margins = E._margins(E._doubtful(df, trained, "test"), n)
    assert margins == E._margins(E._doubtful(df.union(df.where("key = 0")), trained, "test"), n)
    assert 0 <= margins.single < 20 and 0 <= margins.utf8 < 20
    rows = list(enumerate(texts)) + [(9000, "said ca³kiem później świeżą farbę")] + [(10_000 + i, texts[0]) for i in range(6000)]
    got = E.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["doc_id"] == 9000 for r in got)


def test_counts_equal_a_plain_count(spark):
    texts = ["Café noir, 12 CAFÉS\n", "plain  text", "lost �", "x" * 300_000 + " né", "né né"]
    counted = E.count_clean(spark.createDataFrame([(t,) for t in texts], "text string"))
    model = E.train(counted)
    want = {1: {}, 2: {}, 3: {}}
    for t in texts:
        for w in E.fold(t).split(" ") if E.LOST not in t else ():
            for k in (1, 2, 3):
                for i in range(len(w) + 3 - k + 1) if w else ():
                    g = 0
                    for ch in f"  {w} "[i : i + k]:
                        g = g << 21 | ord(ch)
                    want[k][g] = want[k].get(g, 0) + 1
    assert model.counts == want
    assert E.known_words(counted)[0] == {"né": 2, "\na": 0} or E.known_words(counted)[0]["né"] == 2
    fewer = E.train(counted, 0.01).counts
    assert all(set(fewer[k]) < set(want[k]) for k in want)


def test_signs_read_as_utf8_and_short_words(spark):
    """A lone sign that was UTF-8, words that no garbling made, and letters left over where a text was cut."""
    base = [f"the keeper paid £{i} for it… at the café" for i in range(20, 60)] * 4 + corpus(400)
    rows = list(enumerate(base)) + [(9000, "they paid Â£77 for the keeper’s own words"), (9001, "said: wordsâ€¦ and more"), (9002, "после чем ждали сов"), (9003, "всё е"), (9004, "à é ú")]
    got = {r["doc_id"]: r["restored"] for r in E.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {9000: "they paid £77 for the keeper’s own words", 9001: "said: words… and more"}


def test_many_rounds():
    text = "ã ñ ü"
    bad = text
    for _ in range(6):
        bad = spoil(bad, "latin-1", "utf-8")
    counts = {n: {} for n in (1, 2, 3)}
    for t in (text, " ã ", " ñ ", " ü "):
        p = np.frombuffer(f"  {t} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in counts:
            for g in E._grams(p, n).tolist():
                counts[n][g] = counts[n].get(g, 0) + 1000
    judge = E.Judge(E.CharModel(counts), {}, E.Margins(utf8=0.0))
    fixed, taken, _ = judge.restore(bad)
    assert fixed == text and len(taken.split()) == 6


def test_fold_and_tokens():
    assert E.fold("ÄbC\t19\r\n É\ud800") == "Äbc 00   É\ud800"
    assert E.tokens_of(" a\xa0b\n\nc\t\rd ") == ["a\xa0b", "c", "d"] and E.tokens_of("") == []
