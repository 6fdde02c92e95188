import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataweave.llm import languages

SAID = {
    "en": ["the payment worker reads the queue before each release", "we agreed that the cache has to be restarted by hand", "keep in mind that the disk is full when this happens", "nobody has looked at the search index since then"],
    "es": ["el servicio de pagos lee la cola antes de cada entrega", "acordamos que la caché se debe reiniciar a mano", "ten presente que el disco está lleno cuando esto pasa", "nadie ha mirado el índice de búsqueda desde entonces"],
    "fr": ["le service de paiement lit la file avant chaque livraison", "nous avons convenu que le cache doit être relancé à la main", "gardez en tête que le disque est plein quand cela arrive", "personne n'a regardé la recherche interne depuis"],
    "de": ["die Zahlungsstelle liest die Schlange vor jeder Auslieferung", "wir haben vereinbart dass der Speicher von Hand neu gestartet wird", "bitte merken dass die Platte voll ist wenn das passiert", "niemand hat sich seitdem die Volltextsuche angesehen"],
    "pt": ["o serviço de pagamentos lê a fila antes de cada entrega", "combinamos que a memória precisa ser reiniciada manualmente", "não esqueça que o disco está cheio quando isso acontece", "ninguém olhou o índice de buscas desde então"],
}


def test_filter_counts_are_corrected():
    grams = [np.arange(1, 2000, dtype=np.uint64), np.arange(1500, 3500, dtype=np.uint64)]
    f = languages.Filter(grams, bits=14)
    got = f.counts(np.concatenate([grams[0][:1000], np.arange(10_000, 11_000, dtype=np.uint64)]), np.array([0, 1000]))
    assert got[0, 0] > 900 and got[0, 1] < 120 and got[1].max() < 80


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", "en_GB", "español", "es-419", "German", "ger", "und", "", None, "it", "-"]], "l string")
    got = [tuple(r) for r in df.select(languages.label_language(F.col("l")), languages.label_says_nothing(F.col("l"))).collect()]
    assert got == [("en", False), ("en", False), ("es", False), ("es", False), ("de", False), ("de", False), (None, True), (None, True), (None, True), (None, False), (None, True)]


def test_training_survives_wrong_labels():
    rows = [(lang, t) for lang, said in SAID.items() for t in said * 4]
    rows += [("pt", SAID["en"][0]), ("de", SAID["es"][1])]
    model = languages.train(pd.DataFrame(rows, columns=["lang", "text"]))
    for lang, said in SAID.items():
        grams, starts = languages.grams_of(said)
        got, sure = languages.decide(model.counts(grams, starts), 4, 1.2)
        assert [languages.LANGUAGES[i] for i in got] == [lang] * len(said) and (sure > 0.6).all()


def test_cases(spark):
    rows = []
    for lang, said in SAID.items():
        rows += [(f"{lang}{i}", ". ".join(said) + ".", lang) for i in range(6)]
    en, fr, code = ". ".join(SAID["en"]) + ".", ". ".join(SAID["fr"]) + ".", "\n$ run --fast=2 lib/x_1.sql\n"
    rows += [("none", en, None), ("wrong", fr, "de"), ("named", fr, "French"), ("other", en, "it"), ("mixed", en + code + en + " " + fr, "en"), ("short", "the queue reads", None), ("code", code, None), ("empty", "", None), ("null", None, None), (None, en, None)]
    df = spark.createDataFrame(rows, "key string, text string, label string")
    got = {(r.key, r.seg_no, r.lang) for r in languages.label_cases(df, "key", "text", "label").collect()}
    assert got == {("none", 1, "en"), ("wrong", 1, "fr"), ("other", 1, "en"), ("mixed", 1, "en"), ("mixed", 2, "fr")}
    doubled = {(r.key, r.seg_no, r.lang) for r in languages.label_cases(df.union(df), "key", "text", "label").collect()}
    assert doubled == got
    assert languages.label_cases(df.limit(0), "key", "text", "label").count() == 0


def test_confidence_is_how_often_held_out_sentences_are_right():
    f = languages.Filter([np.arange(1, 10, dtype=np.uint64)] * 5)
    rng = np.random.default_rng(2)
    sure = rng.uniform(0.5, 1, 4000)
    f.calibrate(sure, rng.uniform(0, 1, 4000) < sure)
    got = f.confidence(np.array([0.55, 0.75, 0.95]))
    assert np.abs(got - [0.55, 0.75, 0.95]).max() < 0.06 and (np.diff(f.truth) >= 0).all()
    f.calibrate(np.zeros(0), np.zeros(0, dtype=bool))


def test_function_words_tell_sentences_of_other_subjects():
    model = languages.train(pd.DataFrame([(lang, t) for lang, said in SAID.items() for t in said], columns=["lang", "text"]))
    plain = {"de": "Ich weiß nicht, wo mein Bruder mit dem Hund ist.", "es": "No sé dónde está mi hermano con el perro.", "en": "They have been there with their dog for more than two hours."}
    for lang, text in plain.items():
        grams, starts = languages.grams_of([text])
        assert languages.LANGUAGES[languages.decide(model.counts(grams, starts), 4, 1.2)[0][0]] == lang
