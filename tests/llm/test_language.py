import numpy as np
import pytest
from briefmill.llm import language as la
from briefmill.llm import queries
from pyspark.sql import functions as F

TEXTS = {
    "en": ["the old house stands near the river and the children play there", "we would like to see the figures of this month before noon", "please keep the colours calm and leave enough room"],
    "de": ["das alte haus steht am fluss und die kinder spielen dort", "wir möchten die zahlen dieses monats vor dem mittag sehen", "bitte ruhige farben wählen und genügend abstand lassen"],
    "nl": ["het oude huis staat bij de rivier en de kinderen spelen daar", "we willen graag de cijfers van deze maand voor de middag zien", "houd de kleuren rustig en laat genoeg ruimte vrij"],
    "fr": ["la vieille maison se trouve près de la rivière et les enfants jouent", "nous voudrions voir les chiffres de ce mois avant midi", "merci de garder des couleurs calmes et de laisser assez d'espace"],
    "es": ["la casa vieja está cerca del río y los niños juegan allí", "queremos ver las cifras de este mes antes del mediodía", "conviene usar colores tranquilos y dejar suficiente espacio"],
    "pt": ["a casa velha fica perto do rio e as crianças brincam ali", "queremos ver os números deste mês antes do meio-dia", "convém usar cores calmas e deixar espaço suficiente"],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for i in range(40):
        for j, (lang, lines) in enumerate(TEXTS.items()):
            # Every eighth label is wrong.
            rows.append((1000 * j + i, "\n".join(f"{x} {i}" for x in lines), list(TEXTS)[(j + 1) % 6] if i % 8 == 0 else lang.upper(), "clash"))
    rows += [
        (9001, TEXTS["en"][0] + "\n\n" + TEXTS["de"][0] + "\n{\"a\": \"b c d\"}\n12 | 13\n<div class=\"x y z\"></div>", "en_US", "clash"),
        (9002, TEXTS["fr"][1].upper(), None, "clash"),
        (9003, None, "en", "clash"), (9004, "", "en", "clash"), (9005, " \n ", "xx", "clash"), (None, TEXTS["nl"][1], "und", "clash"),
        (9006, "\n".join([TEXTS["pt"][1]] * 3000), "en", "clash"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, line_lang string")
    return la.languages(df, "doc_id", "text", "lang").collect(), la.documents(la.languages(df, "doc_id", "text", "lang"), "doc_id").collect()


WORDS = {
    "en": "the of and to in that is was for with on are this from they have one by had not but what all were when we there can an your which their said if each will other about out many then them these so some her would make like him into time has look two more write go see number no way could people".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(),
    "nl": "de het een en van ik te dat die in je niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze want nog zal me zij nu geen".split(),
    "fr": "le la les de un une et être avoir à il elle ne je son que se qui ce dans en du au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout aller voir bien où sans tu ou leur homme si deux moi vouloir te femme venir quand".split(),
    "es": "el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir otro ese si me ya ver porque dar cuando él muy sin vez mucho saber qué sobre mi alguno mismo yo también hasta año dos querer entre así".split(),
    "pt": "o a de que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha".split(),
}


def test_lines_kept_out_of_training(spark):
    """Lines that no model has seen: their languages are found, and the confidence is about how often that is right."""
    rng = np.random.default_rng(3)
    line = lambda lang: " ".join(rng.choice(WORDS[lang], 14))
    # A tenth of the labels is wrong.
    learn = [(n, "\n".join(line(la) for _ in range(4)), la if n % 10 else list(WORDS)[n // 10 % 6]) for n, la in enumerate(list(WORDS) * 60)]
    kept_out = [(10_000 + n, line(la), la) for n, la in enumerate(list(WORDS) * 60)]
    ddl = "doc_id bigint, text string, lang string"
    model = la.fitted(spark.createDataFrame(learn, ddl), "text", "lang", "doc_id")
    seen = {t for _, text, _ in learn for t in text.split("\n")}
    assert not seen & {t for _, t, _ in kept_out}
    got = {r.doc_id: (r.line_lang, r.confidence) for r in la.languages(spark.createDataFrame(kept_out, ddl), "doc_id", "text", "lang", model).collect()}
    right = np.mean([got[n][0] == lang for n, _, lang in kept_out])
    assert right > 0.95 and abs(np.mean([c for _, c in got.values()]) - right) < 0.1


def test_a_saved_model_scores_alike(spark, tmp_path):
    df = spark.createDataFrame([(n, TEXTS[lang][n % 3], lang) for n, lang in enumerate(list(TEXTS) * 10)], "doc_id bigint, text string, lang string")
    model = la.fitted(df, "text", "lang", "doc_id")
    la.saved(model, f"{tmp_path}/model.npz")
    one, two = (sorted((r.doc_id, r.line_lang, r.confidence) for r in la.languages(df, "doc_id", "text", "lang", m).collect()) for m in (model, la.loaded(f"{tmp_path}/model.npz")))
    assert one == two


def test_lines_learned_from(found):
    lines = [r for r in found[0] if r.doc_id is not None and r.doc_id < 6000]
    right = np.mean([r.line_lang == list(TEXTS)[r.doc_id // 1000] for r in lines])
    assert right > 0.97  # an eighth of the labels they were learned from is wrong


def test_segments_and_edges(found):
    by = {(r.doc_id, r.line_no): r for r in found[0]}
    assert [by[9001, i].line_lang for i in range(6)] == ["en", None, "de", None, None, None]
    assert by[9001, 0].label == "en" and by[9002, 0].label is None and by[9002, 0].line_lang == "fr" and by[None, 0].line_lang == "nl"
    assert (9003, 0) not in by and by[9004, 0].line_lang is None and by[9005, 1].confidence is None
    assert all(0 < r.confidence <= 1 for r in found[0] if r.line_lang)
    docs = {r.doc_id: r for r in found[1]}
    assert docs[9001].mixed and docs[9006].lang == "pt" and not docs[9006].mixed and docs[9006].label == "en" and 9003 not in docs


def test_labels(spark):
    given = ["en", " EN ", "en_GB", "English", "Português", "français", "xx", "", "und", None, "n/a", "deu"]
    rows = spark.createDataFrame([(g,) for g in given], "l string").select(la.label_of(F.col("l")).alias("x")).collect()
    assert [r.x for r in rows] == ["en", "en", "en", "en", "pt", "fr", None, None, None, None, None, "de"]


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, TEXTS["en"][0], "xx")], "doc_id bigint, text string, lang string")
    assert [r.line_lang for r in la.languages(df, "doc_id", "text", "lang").collect()] == [None]
    assert la.languages(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_found_follows_the_lines(spark, tiny):
    lines = {(r.doc_id, r.line_no): r.lang for r in queries.p10_lines(spark, tiny).collect()}
    assert all(lines[r.doc_id, r.line_no] == r.lang for r in queries.p10_found(spark, tiny).collect())
