import json

import pytest
from pyspark.sql import functions as F

from hearken.functions.correct import Rule
from hearken.operators import dataset, evaluation
from hearken.sources import files


def cases(spark, pairs):
    return spark.createDataFrame(pairs, "expected_label string, predicted_label string")


def test_confusion(spark):
    n, p = "normal", "voice_phishing"
    row = evaluation.confusion(cases(spark, [(n, n), (n, p), (p, p), (p, n)])).first()
    assert (row.total, row.true_positive, row.true_negative, row.false_positive, row.false_negative) == (4, 1, 1, 1, 1)
    assert {row.accuracy, row.precision, row.recall, row.f1, row.false_positive_rate, row.false_negative_rate} == {0.5}
    empty = evaluation.confusion(cases(spark, [])).first()
    assert empty.total == 0 and empty.f1 == 0.0
    with pytest.raises(Exception, match="unknown label"):
        evaluation.confusion(cases(spark, [("other", n)])).collect()


def test_published_counts(spark):
    n, p = "normal", "voice_phishing"
    row = evaluation.confusion(cases(spark, [(p, p)] * 194 + [(n, n)] * 155 + [(n, p)] * 148 + [(p, n)] * 2)).first()
    got = [round(100 * x, 2) for x in (row.accuracy, row.precision, row.recall, row.f1, row.false_positive_rate, row.false_negative_rate)]
    assert got == [69.94, 56.73, 98.98, 72.12, 48.84, 1.02]


def test_correction_impact(spark):
    pairs = spark.createDataFrame([("1", "보이스피싱 조심하세요", "보이스피시 조심하세요"), ("2", "같은 말", "같은 말")], "sample_id string, reference string, hypothesis string")
    samples = evaluation.corrected_pairs(pairs, (Rule("typo-1", "보이스피시", "보이스피싱", "s"), Rule("typo-2", "같은", "다른", "s")))
    assert not {"reference", "hypothesis", "corrected"} & set(samples.columns)
    whole = evaluation.correction_summary(samples).first()
    assert (whole.sample_count, whole.changed_sample_count) == (2, 2) and abs(whole.average_raw_cer - 0.05) < 1e-9
    impact = {r.rule_id: (r.application_count, r.improved_sample_count, r.worsened_sample_count, r.unchanged_sample_count) for r in evaluation.rule_impact(samples).collect()}
    assert impact == {"typo-1": (1, 1, 0, 0), "typo-2": (1, 0, 1, 0)}
    with pytest.raises(Exception, match="a pair needs"):
        evaluation.corrected_pairs(spark.createDataFrame([("1", "", "x")], "sample_id string, reference string, hypothesis string"), ()).collect()


def test_mean_of_nothing(spark):
    pairs = spark.createDataFrame([], "reference string, hypothesis string")
    assert evaluation.mean_error_rates(evaluation.error_rates(pairs)).first().mean_cer is None


def test_parsed_case(spark):
    rows = spark.createDataFrame([("a=b.wav=normal",), ("none",), ("=x",)], "s string").select(evaluation.parsed_case(F.col("s")).alias("c")).collect()
    assert (rows[0].c.path, rows[0].c.label) == ("a=b.wav", "normal") and rows[1].c is None and rows[2].c is None


def listed(spark, entries):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in entries], "path string, content binary")


def test_pairing(spark):
    found = listed(spark, [
        ("d/sample.wav", b""), ("d/sample.txt", "안녕".encode()), ("d/alone.wav", b""), ("d/Case.mp3", b""), ("d/case.TXT", b"x"), ("d/case.txt", b"later"),
        ("d/two.mp3", b""), ("d/two.wav", b""), ("d/two.txt", b"ok"), ("d/bad.wav", b""), ("d/bad.txt", b"\xff"), ("d/blank.wav", b""), ("d/blank.txt", b" \n"), ("e/sample.wav", b""), ("d/note.pdf", b""),
    ])
    rows = {r.audio: r for r in dataset.pair_files(found).collect()}
    assert {a: r.issue for a, r in rows.items()} == {
        "d/sample.wav": None, "d/alone.wav": "missing_text", "d/Case.mp3": None, "d/two.mp3": None, "d/two.wav": "duplicate_pair", "d/bad.wav": "invalid_text_encoding", "d/blank.wav": "empty_text", "e/sample.wav": "missing_text",
    }
    assert rows["d/Case.mp3"].transcript == "later" and rows["d/sample.wav"].identifier == "d/sample" and rows["d/sample.wav"].transcript == "안녕"
    short = {r.audio: r.issue for r in dataset.pair_files(found, least_chars=3).collect()}
    assert short["d/two.mp3"] == "short_text" and short["d/two.wav"] == "short_text" and short["d/Case.mp3"] is None
    with pytest.raises(ValueError):
        dataset.pair_files(found, least_chars=0)


def test_split_counts():
    ratios = dataset.Ratios(0.8, 0.1, 0.1)
    assert dataset.split_counts(10, ratios) == (8, 1, 1)
    assert dataset.split_counts(3, ratios) == (2, 1, 1)
    assert sum(dataset.split_counts(590, ratios)) == 590
    with pytest.raises(ValueError):
        dataset.split_counts(2, ratios)
    for wrong in ((0.5, 0.5, 0), (0.5, 0.4, 0.2)):
        with pytest.raises(ValueError):
            dataset.Ratios(*wrong)


def test_split_counts_follow_the_law():
    """Whole parts of the shares, at least one each; what is left goes by the largest fractions; a surplus stays."""
    for parts in ((80, 10, 10), (50, 25, 25), (34, 33, 33), (98, 1, 1), (60, 39, 1), (1, 1, 98)):
        ratios = dataset.Ratios(*(p / 100 for p in parts))
        for total in range(3, 400):
            got, shares = dataset.split_counts(total, ratios), [total * p / 100 for p in parts]
            least = [max(1, int(total * r)) for r in ratios.values]
            assert sum(got) == max(total, sum(least)) and all(a <= b <= a + 1 for a, b in zip(least, got))
            # No split that got one more had a smaller fraction than one that did not.
            more = [x - a for x, a, b in zip(shares, least, got) if b > a]
            rest = [x - a for x, a, b in zip(shares, least, got) if b == a]
            assert not more or not rest or min(more) >= max(rest) - 1e-9


def test_groups_go_to_the_emptiest_split(spark):
    """Each group after the third goes where the ratio of held to wanted pairs is least, the first of equal ones."""
    sizes = [1 + (7 * k) % 5 for k in range(60)]
    pairs = spark.createDataFrame([(f"g{g:02}-{i}", f"g{g:02}") for g, n in enumerate(sizes) for i in range(n)], "identifier string, source_group string")
    for parts, seed, by_hash in (((0.8, 0.1, 0.1), 3, False), ((0.4, 0.3, 0.3), 4, True)):
        done = {r.source_group: (r.position, r.split) for r in dataset.split_groups(pairs, dataset.Ratios(*parts), seed, by_hash).collect()}
        assert sorted(p for p, _ in done.values()) == list(range(60))
        held, wanted = [0, 0, 0], [p * sum(sizes) for p in parts]
        for position, name in sorted((p, g) for g, (p, _) in done.items()):
            k = dataset.SPLITS.index(done[name][1])
            if position < 3:
                assert k == position
            else:
                assert [h / w for h, w in zip(held, wanted)].index(min(h / w for h, w in zip(held, wanted))) == k
            held[k] += sizes[int(name[1:])]


def test_split_by_hash_cuts_at_exact_places(spark):
    import hashlib

    for n in (3, 10, 333):
        pairs = spark.createDataFrame([(f"p{k}",) for k in range(n)], "identifier string")
        got = {r.identifier: r.split for r in dataset.split_by_hash(pairs, dataset.Ratios(0.8, 0.1, 0.1), 5).collect()}
        order = sorted(got, key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
        train, validation, _ = dataset.split_counts(n, dataset.Ratios(0.8, 0.1, 0.1))
        assert [got[i] for i in order] == (["train"] * train + ["validation"] * validation + ["test"] * n)[:n]


def test_grouped_split(spark, tmp_path):
    pairs = spark.createDataFrame([(f"g{k // 3}__chunk_{k}", f"g{k // 3}__chunk_{k}.wav", "t.txt", "안녕") for k in range(12)], "identifier string, audio string, text string, transcript string")
    done = dataset.split_groups(dataset.with_group(pairs), dataset.Ratios(0.5, 0.25, 0.25), 1).cache()
    assert done.count() == 12 and done.select("split").distinct().count() == 3
    assert done.groupBy("source_group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    files.write_manifest(done, str(tmp_path / "m"))
    lines = [json.loads(line) for part in sorted((tmp_path / "m").glob("part-*")) for line in part.read_text().splitlines()]
    place = {r.identifier: (dataset.SPLITS.index(r.split), r.position, r.identifier) for r in done.collect()}
    assert [x["identifier"] for x in lines] == sorted(place, key=place.get) and lines[0]["split"] == "train" and "안녕" in next((tmp_path / "m").glob("part-*")).read_text()
    files.write_manifest(done, str(tmp_path / "one"), one_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    with pytest.raises(ValueError):
        dataset.split_groups(dataset.with_group(pairs.limit(3)), dataset.Ratios(0.5, 0.25, 0.25), 1)
    hashed = dataset.hashed_split(dataset.with_group(pairs), dataset.Ratios(0.5, 0.25, 0.25), 1)
    assert hashed.groupBy("source_group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_random_split(spark):
    pairs = spark.createDataFrame([(f"p{k:02}",) for k in range(10)], "identifier string")
    done = dataset.split_pairs(pairs, dataset.Ratios(0.8, 0.1, 0.1), 42)
    assert {r["split"]: r["count"] for r in done.groupBy("split").count().collect()} == {"train": 8, "validation": 1, "test": 1}
    tiny = dataset.split_pairs(pairs.limit(3), dataset.Ratios(0.8, 0.1, 0.1), 42)
    assert {r["split"]: r["count"] for r in tiny.groupBy("split").count().collect()} == {"train": 2, "validation": 1}


def test_settings_and_manifests(spark, tmp_path):
    good = {"data": {"train_ratio": 0.8, "validation_ratio": 0.1, "test_ratio": 0.1}, "model_name": "m", "language": "ko", "task": "t", "lora": {"target_modules": ["q_proj", "v_proj"]}, "training": {}}
    assert files.checked_settings(good) == good
    for change in ({"language": "en"}, {"lora": {}}, {"data": {}}, {"data": {"train_ratio": 1, "validation_ratio": 1, "test_ratio": 1}}):
        with pytest.raises(ValueError):
            files.checked_settings({**good, **change})
    with pytest.raises(ValueError):
        files.checked_settings({"language": "ko"})
    assert files.model_manifest_problems({"base_model": "b", "adapter_model": "a", "merged": True, "quantization": "int8"}, "b", "a", ["model.bin"]) == []
    assert len(files.model_manifest_problems({}, "b", "a", [])) == 5
    (tmp_path / "rules.json").write_text('[{"rule_id": "r", "source": "a", "target": "b", "reason": "s"}]')
    assert files.load_rules(spark, str(tmp_path / "rules.json"))[0].rule_id == "r"


def test_issues_and_transcripts_are_written(spark, tmp_path):
    pairs = spark.createDataFrame([("a.wav", "a.txt", None), ("b.wav", None, "missing_text"), ("c.wav", "c.txt", "short_text")], "audio string, text string, issue string")
    assert files.write_issues(pairs, str(tmp_path / "issues")) and not files.write_issues(pairs.where("issue is null"), str(tmp_path / "none"))
    assert {(r.code, r.path) for r in spark.read.json(str(tmp_path / "issues")).collect()} == {("missing_text", "b.wav"), ("short_text", "c.txt")}
    assert not (tmp_path / "none").exists()
    segments = "array<struct<start:double,end:double,transcript:string,suspicion_score:double>>"
    calls = spark.createDataFrame([("x", " said so ", [(0.0, 30.0, "said", 0.5), (30.0, 60.0, "so", 0.1)]), ("y", "none", [])], f"call_id string, raw_transcript string, reference_segments {segments}")
    files.write_transcripts(calls, str(tmp_path / "out"))
    assert next((tmp_path / "out/transcripts/call_id=x").glob("part-*")).read_text() == "said so\n"
    assert [json.loads(x)["transcript"] for x in next((tmp_path / "out/segments/call_id=x").glob("part-*")).read_text().splitlines()] == ["said", "so"]


def test_settings_file(spark, tmp_path):
    (tmp_path / "run.yaml").write_text("data: {train_ratio: 0.8, validation_ratio: 0.1, test_ratio: 0.1}\nmodel_name: m\nlanguage: ko\ntask: t\nlora: {target_modules: [q_proj, v_proj]}\ntraining: {}\n")
    assert files.load_settings(spark, str(tmp_path / "run.yaml"))["model_name"] == "m"
    (tmp_path / "bad.yaml").write_text("language: en\n")
    with pytest.raises(ValueError):
        files.load_settings(spark, str(tmp_path / "bad.yaml"))


def test_command_line(spark, tmp_path, capsys):
    from hearken import __main__ as command

    (tmp_path / "run.yaml").write_text("data: {train_ratio: 0.5, validation_ratio: 0.25, test_ratio: 0.25, seed: 1, group_by_source: true, extensions: [.wav]}\nmodel_name: m\nlanguage: ko\ntask: t\nlora: {target_modules: [q_proj, v_proj]}\ntraining: {}\n")
    (tmp_path / "data").mkdir()
    for k in range(8):
        (tmp_path / f"data/S{k // 2}__{k:04}.wav").write_bytes(b"x")
        (tmp_path / f"data/S{k // 2}__{k:04}.txt").write_text("안녕")
    (tmp_path / "data/alone.wav").write_bytes(b"x")
    assert command.main(["prepare", "--settings", str(tmp_path / "run.yaml"), "--data", str(tmp_path / "data"), "--out", str(tmp_path / "out")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert sum(told["counts"].values()) == 8 and all(n % 2 == 0 and n for n in told["counts"].values()) and told["issues"] == 1
    assert spark.read.json(str(tmp_path / "out/manifest")).count() == 8 and spark.read.json(str(tmp_path / "out/issues")).first().code == "missing_text"
    spark.createDataFrame([("a", "normal"), ("b", None)], "call_id string, label string").write.parquet(str(tmp_path / "calls"))
    command.main(["evaluate", "--calls", str(tmp_path / "calls"), "--case", "a=normal", "--case", "b=normal"])
    told = json.loads(capsys.readouterr().out)
    assert told["metrics"]["true_negative"] == 1 == told["metrics"]["total"] and told["without_label"] == 1
    with pytest.raises(ValueError):
        command.evaluate(["nothing"], spark.read.parquet(str(tmp_path / "calls")))


def test_mean_error_rates_of_all_samples(spark, tmp_path):
    """Against brute force by code points, with letters beyond ASCII."""
    from hearken.plans import queries

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    said = [(1, 0, "la nation des élèves"), (1, 1, "für the Nationen über"), (2, 1, "계좌 ation 확인 the 요청"), (3, 0, "plain the station"), (5, 0, "même nation")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    bare = lambda t: "".join(x for x in t if x.isalnum())
    rates = []
    for c, t, x in said:
        heard = x if c % 5 == 0 else x.replace("ation", "asion").replace(" the ", " " if t % 2 == 0 else " tha ")
        rates.append(distance(bare(x), bare(heard)) / len(bare(x)))
    got = queries.QUERIES["mean_error_rates"](spark, str(tmp_path)).first()
    assert got.n_samples == 5 and abs(got.mean_cer - sum(rates) / 5) < 1e-6
