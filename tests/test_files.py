import json
import os

from pyspark.sql import functions as F

from tidemark.functions import markdown
from tidemark.sources import files
from tidemark.streaming import watch


def test_chat_log_keeps_the_order(spark, tmp_path):
    said = [{"role": "user", "nickname": "a", "time": "23:59:00", "content": "x"}, {"role": "assistant", "nickname": "b", "time": "00:01:00", "content": "y\nz"}]
    (tmp_path / "chat.json").write_text(json.dumps(said, indent=1))
    (tmp_path / "none.json").write_text("[]")
    got = files.chat_log(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.role, r.content) for r in got] == [(0, "user", "x"), (1, "assistant", "y\nz")]


def test_markdown_tree_is_parsed(spark, tmp_path):
    rows = [("p1", "o1", "global", "cold", -0.75, 0.1, 0.53, 0.9, 0.8, ["7", "8"]), ("p1", "o2", "g1", "affinity", 0.6, 0.0, 0.42, 1.0, 0.29, []), ("p2", "o1", "g1", "active", 0.3, 0.3, 0.3, 1.0, 0.5, ["9"])]
    names = "subject string, observer string, scope string, orientation string, benevolence double, power double, intensity double, fit double, confidence double, evidence array<string>"
    df = spark.createDataFrame(rows, names)
    for r in markdown.render(df).collect():
        (tmp_path / r.subject).mkdir()
        (tmp_path / r.subject / "IMPRESSIONS.md").write_text(r.content + "\n\n## 来自 `x` 的印象（范围：y）\n\n| 社交取向 | 亲和 |\n")
        (tmp_path / r.subject / "PROFILE.md").write_text("no")
    got = markdown.parse(files.markdown_tree(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_changed_files(spark, tmp_path):
    for n in ("a.md", "b.md", "c.md"):
        (tmp_path / n).write_text(n)
        os.utime(tmp_path / n, (1_700_000_000, 1_700_000_000))
    before = spark.createDataFrame(files.listing(spark, str(tmp_path), "*.md").collect())
    assert before.count() == 3
    os.utime(tmp_path / "b.md", (1_700_000_100, 1_700_000_100))
    (tmp_path / "d.md").write_text("new")
    got = files.changed(files.listing(spark, str(tmp_path), "*.md"), before)
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["b.md", "d.md"]


def test_summaries(spark, tmp_path):
    rows = [("g1", "2024-01-02", "# later\ntext"), ("g1", "2024-01-01", "# early"), (None, "2024-01-03", "# private"), ("a", "2024-01-01", "# a")]
    files.write_summaries(spark.createDataFrame(rows, "group_id string, date string, document string"), str(tmp_path / "s"))
    assert [tuple(r) for r in files.summaries(spark, str(tmp_path / "s")).collect()] == [rows[3], rows[0], rows[1], rows[2]]


def test_audit_lines_add_up(spark, tmp_path):
    for k in range(3):
        files.append_audit(spark.range(1).select(F.lit(k).alias("moved")), str(tmp_path / "audit"))
    assert sorted(r.moved for r in spark.read.json(str(tmp_path / "audit")).collect()) == [0, 1, 2]


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "snap")
    assert files.versions(spark, base) == []
    assert [files.write_snapshot(spark.range(k), base) for k in (1, 2, 3)] == [1, 2, 3]
    (tmp_path / "snap" / "version=4").mkdir()  # never finished
    assert files.read_snapshot(spark, base).count() == 3 and files.read_snapshot(spark, base, 1).count() == 1
    assert files.prune_snapshots(spark, base, 0) == [1, 2] and files.versions(spark, base) == [3]


def test_migrate(spark):
    steps = [(2, lambda d: d.withColumn("b", F.col("a") * 2)), (1, lambda d: d.withColumn("a", F.col("a") + 1))]
    schema = {"a": ("long", F.lit(0)), "b": ("string", F.lit("")), "locked": ("boolean", F.lit(False))}
    out, version = files.migrate(spark.createDataFrame([(1,)], "a int"), schema, steps, 0)
    assert version == 2 and [tuple(r) for r in out.collect()] == [(2, "4", False)]
    again, version = files.migrate(out, schema, steps, version)
    assert version == 2 and again.schema == out.schema and again.collect() == out.collect()


def test_edited_files_arrive_again(spark, tmp_path):
    watch.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, said, time):
        (folder / name).write_text(said)
        os.utime(folder / name, (time, time))

    def run():
        stream = spark.readStream.format("file_changes").option("path", str(folder)).option("suffix", ".md").option("files", 2).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.path.rsplit("/", 1)[1], r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k in range(5):
        write(f"{k}.md", f"v{k}", 1_700_000_000 + k)
    write("no.txt", "no", 1_700_000_009)
    assert run() == [(f"{k}.md", f"v{k}") for k in range(5)]
    write("1.md", "edited", 1_700_000_100)
    write("new.md", "n", 1_700_000_100)
    assert run() == sorted([(f"{k}.md", f"v{k}") for k in range(5)] + [("1.md", "edited"), ("new.md", "n")])
    assert len(run()) == 7  # nothing new
