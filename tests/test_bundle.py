from glyphmill.plans.bundle import LanguageModels, release_name


def test_train_save_load_export(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat."), (2, "the cat ran, the dog sat")], "doc_id bigint, text string")
    m = LanguageModels.train(docs)
    m.save(str(tmp_path / "m"))
    again = LanguageModels.load(spark, str(tmp_path / "m"))
    assert m.same_as(again)
    assert not m.same_as(LanguageModels.train(docs.where("doc_id = 1")))
    assert len(m.export(str(tmp_path / "files"))) == 5
    got = again.correct_and_generate(spark.createDataFrame([(7, "the cax")], "id bigint, text string"), 2, ("id",)).first()
    assert got["corrected"] == "the cat" and isinstance(got["generated"], str)
    assert release_name("en", "20260901") == "language-models-en-20260901"
