import pytest

from spanlens.llm import fertility

NATURAL = {
    "en": "The committee met on Tuesday to discuss the proposed changes to the city budget, and several members said that "
          "they would prefer to wait until the new figures from the treasury had been published before they took a final "
          "vote on the matter.",
    "de": "Der Ausschuss trat am Dienstag zusammen, um über die vorgeschlagenen Änderungen des städtischen Haushalts zu "
          "beraten, und mehrere Mitglieder erklärten, sie wollten lieber warten, bis die neuen Zahlen des "
          "Finanzministeriums veröffentlicht seien, bevor sie endgültig abstimmen.",
    "fr": "Le comité s'est réuni mardi pour examiner les modifications proposées au budget de la ville, et plusieurs "
          "membres ont déclaré qu'ils préféraient attendre la publication des nouveaux chiffres du trésor avant de se "
          "prononcer définitivement sur cette question.",
    "es": "El comité se reunió el martes para debatir los cambios propuestos en el presupuesto de la ciudad, y varios "
          "miembros dijeron que preferían esperar hasta que se publicaran las nuevas cifras del tesoro antes de votar "
          "definitivamente sobre el asunto.",
}
LONGER = {
    "en": " She walked along the river every morning, stopped at the old bridge, and counted the boats that had come in "
          "during the night. Nobody else seemed to notice them, but for her they were the first sign of spring.",
    "de": " Sie ging jeden Morgen am Fluss entlang, blieb an der alten Brücke stehen und zählte die Boote, die in der "
          "Nacht gekommen waren. Niemand sonst schien sie zu bemerken, doch für sie waren sie das erste Zeichen des "
          "Frühlings.",
    "fr": " Elle marchait chaque matin le long de la rivière, s'arrêtait au vieux pont et comptait les bateaux arrivés "
          "pendant la nuit. Personne d'autre ne semblait les remarquer, mais pour elle c'était le premier signe du "
          "printemps.",
    "es": " Caminaba cada mañana por la orilla del río, se detenía en el viejo puente y contaba los barcos que habían "
          "llegado durante la noche. Nadie más parecía verlos, pero para ella eran la primera señal de la primavera.",
}


@pytest.mark.parametrize("lang", sorted(NATURAL))
def test_natural_prose_is_kept(spark, lang):
    texts = [NATURAL[lang], NATURAL[lang] + LONGER[lang]]
    df = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [r.kept for r in fertility.quality(df).orderBy("doc_id").collect()] == [True, True]
    assert fertility.keep_good(df).count() == 2


def test_letters_at_random_still_go(spark):
    from tests.llm import cases

    junk = cases.sentence(cases.random.Random(3), 200)
    df = spark.createDataFrame([(1, junk, "en")], "doc_id long, text string, lang string")
    assert not fertility.quality(df).first().kept
