import corpus_pipeline
from tests.llm.test_search import by_jaccard
from tidelens.llm import language, quality_rules, secrets


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        rows = {r.doc_id: r for r in before.collect()}
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            measure = quality_rules.measurer()
            assert kept[name] == {i for i, r in rows.items() if measure(r.text)[6]}
        elif name == "language_id":
            model = language.fit(before)
            names, scores = model.predict([r.text for r in rows.values()])
            assert kept[name] == {i for i, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.MIN_SCORE}
            assert len(kept[name]) >= 0.99 * len(rows)
        elif name == "simhash":
            root = by_jaccard({i: r.text for i, r in rows.items()})
            assert kept[name] == {i for i, c in root.items() if i == c}
        elif name == "secrets":
            assert kept[name] == set(rows)
            assert secrets.scan(docs).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            assert kept[name] == set(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash", "secrets", "packing"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_foreign_languages_and_noise_go(spark, sf):
    """Texts in no language of the table go, of the clean ones nearly all stay."""
    import random

    rng = random.Random(5)
    foreign = [
        "Tämä on suomenkielinen lause, joka kertoo kesäisestä päivästä järven rannalla ja vanhasta talosta.",
        "To jest zdanie po polsku, które opowiada o letnim dniu nad jeziorem i o starym domu w lesie.",
        "Αυτή είναι μια πρόταση στα ελληνικά που μιλάει για μια καλοκαιρινή μέρα.",
        "Это предложение на русском языке рассказывает о летнем дне у озера.",
        "这是一个关于夏日湖边的中文句子，讲述了一座老房子的故事。",
        "Dit is een zin in het Nederlands over een zomerdag aan het meer en een oud huis.",
        "Ez egy magyar mondat, amely egy nyári napról szól a tó partján és egy régi házról.",
    ]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(2, 10))) for _ in range(100)) for _ in range(100)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 1000000")
    clean = quality_rules.quality_filter(docs)
    added = [(1_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(foreign + noise)]
    kept = [r.doc_id for r in corpus_pipeline.languages(spark, clean.union(spark.createDataFrame(added, docs.schema)), sf).collect()]
    assert [i for i in kept if i >= 1_000_000] == []
    assert len(kept) >= 0.99 * clean.count()


def test_pieces_hold_their_token_ids(spark, sf):
    import zlib

    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    rows = corpus_pipeline.pack(spark, docs, sf).collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
