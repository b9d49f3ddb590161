import random

import numpy as np
import pytest

from fleetloom.llm import subjects as subject_module
from fleetloom.llm.subjects import (
    Languages, SubjectRules, cut_blocks, edge_candidates, edge_lines, kept_edges, language_code, learn_languages, lines_of, parts_of, sentences_of, subjects_of, vocabulary,
)

WORDS = {
    "metal": "furnace anvil rivet solder copper forge chisel ingot slag billet".split(),
    "garden": "tulip hedge compost mulch sapling trowel orchard bulb lawn prune".split(),
    "music": "cello tempo chorus fugue sonata violin chord octave rehearsal tune".split(),
}
PLAIN = "please note again today the list is long and was not done by them".split()


def corpus(n, seed):
    rng, rows, truth = random.Random(seed), [], {}
    for k in range(n):
        about = rng.sample(list(WORDS), rng.choice([1, 1, 2]))
        lines = []
        for s in about:
            lines += [" ".join(["the", *rng.sample(WORDS[s], 4), "and", "is"]).capitalize() + "." for _ in range(4)]
        lines += [" ".join(rng.sample(PLAIN, 6)).capitalize() + "." for _ in range(2)]
        rng.shuffle(lines)
        rows.append((k, "Hello everyone,\n" + " ".join(lines) + "\nPlay a violin sonata chord in our rehearsal.", "en", "x"))
        truth[k] = set(about)
    return rows, truth


def blocks_of(documents, rules=SubjectRules()):
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text", language_code("lang").alias("language"))
    languages = learn_languages(rows, rules)
    blocks = cut_blocks(rows, edge_candidates(rows, rules), languages, rules)
    return languages, blocks, kept_edges(blocks, rules)


def bodies(documents, rules=SubjectRules()):
    """doc_id -> language and sentences, out of the blocks."""
    languages, blocks, edges = blocks_of(documents, rules)
    out = {}
    for b in blocks.collect():
        for k, p in parts_of(b, np.array(edges, int), len(languages.names)):
            ends, word_ends = np.cumsum(p.sentences), np.cumsum(p.lengths)
            for d, n, end in zip(p.ids.tolist(), p.sentences, ends):
                own = [" ".join(b.words[c] for c in p.codes[word_ends[i] - p.lengths[i] : word_ends[i]]) for i in range(end - n, end)]
                out[d] = languages.names[k], own
    return out


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([(s, f"All about {' '.join(w[:2])}") for s, w in WORDS.items()], "subject string, description string")


def test_held_out_documents_and_wrong_labels(spark, subjects):
    rows, truth = corpus(300, 1)
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, " \n 12 ?? ", "de", "x"), (1003, "the tulip hedge compost lawn is. " * 3000, "en", "x"), (None, "the tulip", "en", "x"), (1004, "\u0000 <p>&nbsp;</p>", "en", "x")]
    labels = [(k, s) for k in range(100) for s in truth[k]] + [(3, "music"), (5, "metal"), (5, None), (None, "metal"), (7, "unknown"), (8888, "metal")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, sentences string")
    got = {}
    for r in subjects_of(df, subjects, spark.createDataFrame(labels, "doc_id long, subject string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(k, set()) == truth[k] for k in range(100, 300))
    assert right >= 190
    assert got[1003] == {"garden"} and not {1000, 1001, 1002, 1004, None} & set(got)


def test_no_labels_no_documents_no_subjects(spark, subjects):
    rows, _ = corpus(20, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, x string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects_of(df.where("false"), subjects, none).count() == 0
    assert subjects_of(df, subjects.where("false"), none).count() == 0
    assert subjects_of(df, subjects, none, SubjectRules(rank=4)).select("doc_id").distinct().count() <= 20


def test_edges_are_learned_from_all_documents(spark):
    rows, _ = corpus(40, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, x string")
    words = [s for _, own in bodies(df).values() for s in own]
    assert not any("hello everyone" in s or "in our rehearsal" in s for s in words) and len(words) > 200


def test_recurring_body_sentences_stay(spark):
    body = [f"{a} {b} rolls." for a in ("tulip", "hedge", "anvil", "cello") for b in ("one", "two", "three", "four", "five")]
    texts = []
    for k, own in enumerate(body):
        lines = [own, *(f"{own} line {c}." for c in "abcdef")]
        lines.insert(k % 8, "More on this tomorrow.")  # anywhere, so sometimes at an edge
        texts.append("\n".join(["Hello everyone,", *lines, "Sent from afar"]))
    # a real header is body where it stands in the middle
    texts.append("\n".join(["Hello everyone,", "b c d", "e f g", "Hello everyone,", "h i j", "k l m", "n o p", "Sent from afar"]))
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {k: own for k, (_, own) in bodies(df).items()}
    assert all(got[k].count("more on this tomorrow") == 1 and "sent from afar" not in got[k] for k in range(20))
    assert all("hello everyone" not in got[k] for k in range(20)) and got[20].count("hello everyone") == 1


def test_rare_words_are_measured_against_their_language(spark):
    rows = [("en", "van rolls")] * 200 + [("en", "typo rolls")] * 5 + [("nl", "wagen rijdt")] * 10 + [("nl", "pakket rijdt")] * 5 + [("nl", "foutje")] * 2
    df = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    languages, blocks, edges = blocks_of(df)
    terms = vocabulary(blocks, edges, languages, SubjectRules(least_share=0.05))
    assert set(terms["en"][0]) == {"van", "rolls"} and set(terms["nl"][0]) == {"wagen", "rijdt", "pakket"}


def test_a_language_of_one_in_a_thousand_has_subjects(spark, subjects):
    rows, truth = corpus(3000, 5)
    rare = {"metal": "enclume rivet forge ciseau".split(), "garden": "haie tulipe verger taille".split()}
    rng = random.Random(6)
    for k, about in enumerate(["metal", "garden", "metal", "garden", "metal", "garden"]):
        text = " ".join(" ".join(["le", *rng.sample(rare[about], 3), "est", "une"]) + "." for _ in range(6))
        rows.append((5000 + k, text, "fr" if k != 2 else "en", "x"))
        truth[5000 + k] = {about}
    labels = [(k, s) for k in [*range(100), 5000, 5001] for s in truth[k]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, x string").repartition(4)
    got = {r.doc_id: r.subject for r in subjects_of(df, subjects, spark.createDataFrame(labels, "doc_id long, subject string")).where("doc_id >= 5000").collect()}
    assert got == {5000 + k: s for k, s in enumerate(["metal", "garden"] * 3)}


def test_no_vocabulary_cap(spark):
    rows = [(k, " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[k // 26 % 26]}{'abcdefghijklmnopqrstuvwxyz'[k % 26]}word{'xyz'[j % 3] * (j // 3 + 1)}" for j in range(60)), "en") for k in range(500) for _ in range(3)]
    languages, blocks, edges = blocks_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(vocabulary(blocks, edges, languages, SubjectRules())["en"][0]) == 500 * 60


def test_texts_are_cut_to_sentences():
    assert lines_of("<p>One &amp; two.</p><p>Three</p>\n\n a < b ") == ["One & two.", "Three", "a < b"]
    assert sentences_of("Dear all,\nIt is 12:30. Go home! Really? 17\nBye", frozenset({"dear all", "bye"})) == ["it is", "go home", "really"]
    assert sentences_of("Bye", frozenset({"bye"})) == ["bye"]
    assert [len(s.split()) for s in sentences_of("word " * 33, frozenset())] == [8, 8, 8, 9]
    assert sentences_of(None, frozenset()) == [] and edge_lines(None) == [] and edge_lines("one line") == []
    assert edge_lines("Ref 12\nb\nc\nd\ne\nf") == ["b", "d", "e", "f", "ref"]


SPOKEN = {
    "en": ["the van is not here", "the road was closed for the day", "it is not known when the parcel was lost"],
    "nl": ["het pakket is niet voor de buren", "de weg was de hele dag dicht", "het is niet bekend waar de wagen is"],
    "de": ["der wagen ist nicht da", "die strasse war den tag gesperrt", "es ist nicht bekannt wo das paket ist"],
    "fr": ["le camion est dans la rue", "la route est pour les colis", "les clients sont dans le magasin"],
    "es": ["el camion esta en la calle", "la calle es para los paquetes", "los clientes son de la tienda"],
}


@pytest.mark.parametrize(
    "text,given,want",
    [("het pakket is niet voor de buren", "en", "nl"), ("der wagen ist nicht da", None, "de"), ("the van was not here", "nl", "en"), ("le camion est dans la rue", "fr", "fr"), ("la calle es para el camion", "es", "es"),
     ("les colis sont dans le magasin", None, "fr"), ("xyz", "de", "de"), ("xyz", "xx", "en"), ("", "fr", "fr")],
)
def test_languages_are_learned_from_lang(spark, text, given, want):
    rows = [(k, t, g) for k, (g, t) in enumerate((g, t) for g, own in SPOKEN.items() for t in own for _ in range(2 if g == "en" else 1))]
    assert learn_languages(spark.createDataFrame(rows, "doc_id long, text string, language string"), SubjectRules()).of_text(text, given) == want


def test_language_codes_and_no_languages(spark):
    df = spark.createDataFrame([("EN",), (" en-GB",), ("en_us",), ("english",), ("",), (None,), ("deu",)], "lang string")
    assert [r[0] for r in df.select(language_code("lang")).collect()] == ["en", "en", "en", None, None, None, "deu"]
    assert Languages.learned({}, {}, {}).of_text("the van") == "und"
    assert list(bodies(spark.createDataFrame([(1, "the van. it rolls", None)], "doc_id long, text string, lang string")).values()) == [("und", ["the van", "it rolls"])]


def test_passes_are_not_cut():
    assert SubjectRules().power_passes >= 3 and SubjectRules().corpus_rounds >= 3


def test_products_of_sparse_and_dense_tiles_are_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    dense = rng.random((53, 40)) * (rng.random((53, 40)) < 0.1)
    dense[17] = 0
    row, col = np.nonzero(dense)
    q = rng.normal(size=(40, 5)).astype("f4")
    for share in (0.0, 2.0):
        for tile in (40, 400, 10**6):
            monkeypatch.setattr(subject_module, "DENSE", share)
            monkeypatch.setattr(subject_module, "TILE", tile)
            args = row, col, dense[row, col].astype("f4"), 53, q
            assert np.allclose(subject_module._products(*args, False), dense.T @ (dense @ q), atol=1e-4)
            assert np.allclose(subject_module._products(*args, True), (dense @ q).T @ (dense @ q), atol=1e-4)
