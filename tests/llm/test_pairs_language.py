import pytest
from pyspark.sql import functions as F

from kgweave.llm import language as L
from kgweave.llm import pairs as P

TEXT = {
    "en": "The parser reads all the files in the folder and writes the result to the table. When the run ends, the report shows how many of them were dropped. There is no limit for this step. We should call it before the loader starts.",
    "de": "Der Parser liest alle Dateien im Ordner und schreibt das Ergebnis in die Tabelle. Wenn der Lauf endet, zeigt der Bericht, wie viele davon verworfen wurden. Es gibt keine Grenze für diesen Schritt. Wir sollten ihn vor dem Lader aufrufen.",
    "fr": "Le lecteur lit tous les fichiers du dossier et écrit le résultat dans la table. À la fin, le rapport montre combien de fichiers ont été rejetés. Il n'y a pas de limite pour cette étape. Il faut appeler la fonction avant le début.",
    "es": "El lector lee todos los archivos de la carpeta y escribe el resultado en la tabla. Al final el informe muestra cuántos archivos se han descartado. No hay ningún límite para este paso. Hay que llamar a la función antes de empezar.",
    "pt": "O leitor lê todos os arquivos da pasta e escreve o resultado na tabela. No fim o relatório mostra quantos arquivos foram descartados. Não há nenhum limite para este passo. É preciso chamar a função antes de começar.",
    "it": "Il lettore legge tutti i file della cartella e scrive il risultato nella tabella. Alla fine il rapporto mostra quanti file sono stati scartati. Non c'è nessun limite per questo passo. Bisogna chiamare la funzione prima di iniziare.",
    "nl": "De lezer leest alle bestanden in de map en schrijft het resultaat in de tabel. Aan het einde toont het rapport hoeveel bestanden zijn weggegooid. Er is geen grens voor deze stap. Roep de functie aan voordat de lader begint.",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 10 + i, TEXT[code], code) for k, code in enumerate(TEXT) for i in range(4)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs)


def test_bitmask_equals_sets_but_for_false_positives(model):
    fresh = L.LanguageModel()
    members = {f"g{k}": 1 << k % 7 for k in range(3000)}
    for g, m in members.items():
        fresh.add(g, m)
    fresh.finish()
    assert all(fresh.mask(g) & m == m for g, m in members.items())  # never a miss
    extra = sum(bin(fresh.mask(f"x{k}")).count("1") for k in range(20_000)) / 20_000 / 7
    assert extra < 20 * max(fresh.false_rate) + 1e-4


def test_every_language(model):
    for code, text in TEXT.items():
        assert L.label_text(model, text)[0][1] == code
    assert L.label_text(model, None) == L.label_text(model, "") == L.label_text(model, "```\ndef the_and(of):\n    return the\n```") == L.label_text(model, "TODO") == []


def test_mixed_damaged_and_quoted(model):
    mixed = TEXT["en"] + "\n\n" + TEXT["fr"]
    runs = L.label_text(model, mixed)
    assert [r[1] for r in runs[1:]] == ["en", "fr"] and mixed[runs[2][4] : runs[2][5]].strip().startswith("Le lecteur")
    assert {r[1] for r in L.label_text(model, TEXT["en"] + ' It printed ("le lecteur lit tous les fichiers") once.')} == {"en"}
    import unicodedata

    assert L.label_text(model, unicodedata.normalize("NFD", TEXT["pt"]))[0][1] == "pt"
    assert L.label_text(model, TEXT["fr"].encode("utf-8").decode("cp1252", "replace"))[0][1] == "fr"
    assert len(L.label_text(model, TEXT["de"] * 500)) == 2  # whole long texts


def test_held_out_accuracy_and_labels(spark, docs, model):
    rows = [(1, TEXT["nl"], "NL"), (2, TEXT["nl"], "en"), (3, TEXT["de"], None), (4, TEXT["en"], " English "), (5, TEXT["it"], "ita"), (6, "", None), (7, None, "en"), (8, TEXT["en"] + " " + TEXT["es"], "en-US"), (2, TEXT["nl"], "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("label", F.lit("clash")).withColumn("segment", F.lit(9))
    seg = L.label_segments(df, model)
    assert {tuple(r) for r in L.relabelled(seg).collect()} == {(2, "nl"), (3, "de"), (8, "en"), (8, "es")}
    assert seg.where("doc_id in (6, 7) and found_lang is null").count() == 2 and L.label_segments(df.limit(0), model).count() == 0
    empty = L.fit(docs.limit(0))
    assert L.label_text(empty, TEXT["en"]) is not None


Q = "How does the parser read the files in the folder of the table?"


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, "**Answer:**\n", "empty"), (Q, "N/A", "empty"), (Q, "​", "empty"), (Q, "> " + Q, "copy"), (Q, "Q: " + Q + "\nA: " + Q, "copy"), (Q, Q.upper(), "copy"),
        (Q, "Sorry, I can't help with that, please ask the maintainers instead.", "refusal"), (Q, "> " + Q + "\n\nLeider kann ich nicht helfen.", "refusal"),
        (Q, "The server declines requests without an id.", None), (Q, "Sorry for the long list. " + TEXT["en"], None), (Q, TEXT["en"] + " The rest of it is...", "truncated"), (Q, TEXT["en"] + "\n```\ndef f(x):", "truncated"),
        (Q, TEXT["en"] + "\n- `a`\n- `b`", None), (Q, "Twice.", None), (Q, TEXT["de"], "language"), ("Please answer in German. " + Q, TEXT["de"], None), (Q, Q + "\n\nThe short answer: " + TEXT["en"], None), (None, TEXT["en"], None),
    ],
)
def test_judge(model, question, answer, defect):
    assert P.judge(model, question, answer)[0] == defect


def test_unmarked_endings_by_the_corpus(spark, model):
    whole = "When the run ends, the report shows how many of the files were dropped"
    rows = [(f"c{k}", Q, whole + ".", 1) for k in range(12)] + [("open", Q, whole, 1), ("cut", Q, "When the run ends, the report shows how many of the", 1), ("word", Q, "When the run ends, the rep", 1), ("cut", Q, "When the run ends, the report shows how many of the", 1), (None, Q, "", 1)]
    df = spark.createDataFrame(rows, "id string, question string, summary string, defect int")
    assert {tuple(r) for r in P.broken_pairs(df, model).collect()} == {("cut", "truncated"), ("word", "truncated"), (None, "empty")}
    assert P.broken_pairs(df.limit(0), model).count() == 0


def test_lcs_equals_brute_force():
    import random
    from functools import lru_cache

    rng = random.Random(3)
    for _ in range(40):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(8))], [rng.choice("abc") for _ in range(rng.randrange(8))]

        @lru_cache(None)
        def f(i, j, a=tuple(a), b=tuple(b)):
            return 0 if i == len(a) or j == len(b) else 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

        assert P.lcs(a, b) == f(0, 0)


def test_fit_reads_whole_texts(docs, model):
    late = L.fit(docs.withColumn("text", F.concat(F.lit("1 " * 11_000 + "\n\n"), "text")))
    assert bytes(late.slots) == bytes(model.slots)


def test_lcs_equals_the_table():
    import random

    from kgweave.llm import pairs

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in "ab")
        assert pairs.lcs(a, b) == table(a, b)
    long = [str(rng.randrange(50)) for _ in range(5000)]
    assert pairs.lcs(long, long) == 5000
