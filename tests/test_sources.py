"""CSV dialect and loading stages."""

import datetime as dt
import gzip

import pytest

from opinara.operators import metrics, sentiment
from opinara.sources import reviews as source
from opinara.sources.sinks import shared_folder, table_stream

CSV = '''Id,ProductId,UserId,Score,Time,Summary,Text
1,B1,U1,5,1350777600,"Said ""wow""","Two
lines, one field"
2,B2,U2,1,1350777601,short,NA
3,B1,U3,NaN,1350777602,none,kept text
4,NULL,U4,3,oops,N/A,"plain"
5,B3,U5,4.0,0,"",last
'''


def load(spark, tmp_path, content=CSV, multi_line=True, **options):
    path = tmp_path / "reviews.csv"
    path.write_text(content)
    return source.read_csv(spark, str(path), multi_line, **options)


def test_csv_dialect(spark, tmp_path):
    df = load(spark, tmp_path)
    assert df.columns == ["Id", "ProductId", "Score", "Time", "Summary", "Text"]
    rows = {r.Id: r for r in df.collect()}
    assert rows[1].Text == "Two\nlines, one field" and rows[1].Summary == 'Said "wow"'
    assert rows[2].Text is None and rows[3].Score is None
    assert rows[4].ProductId is None and rows[4].Summary is None and rows[4].Time is None
    assert rows[5].Score == 4 and rows[5].Summary is None


def test_load_drops_incomplete_rows_after_sampling(spark, tmp_path):
    raw = load(spark, tmp_path)
    assert sorted(r.Id for r in source.load_reviews(raw).collect()) == [1, 4, 5]
    stats = {r.stage: r.n for r in source.load_stats(raw).collect()}
    assert stats == {"raw": 5, "sampled": 5, "clean": 3}
    sampled = {r.stage: r.n for r in source.load_stats(raw, sample_size=4).collect()}
    assert sampled["raw"] == 5 and sampled["sampled"] == 4
    assert sampled["clean"] == source.load_reviews(raw, sample_size=4).count()


def test_dates(spark, tmp_path):
    rows = {r.Id: r for r in source.load_reviews(load(spark, tmp_path)).collect()}
    assert rows[1].Date == dt.datetime(2012, 10, 21)
    assert (rows[1].YearMonth, rows[1].Year, rows[1].Month) == (dt.date(2012, 10, 1), 2012, 10)
    assert rows[5].Date == dt.datetime(1970, 1, 1) and rows[4].Date is None


def test_single_line_files_and_missing_columns(spark, tmp_path):
    df = load(spark, tmp_path, "Text,Score\nfirst,5\nsecond,1\n", multi_line=False)
    loaded = source.load_reviews(df)
    assert loaded.columns == ["Score", "Text", "Id"]
    assert [r.Text for r in loaded.orderBy("Id").collect()] == ["first", "second"]


def test_files_with_another_header_are_refused(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("Id,Score,Text\n1,5,first\n")
    (folder / "b.csv").write_text("Id,Score,Text\n2,4,second\n")
    assert sorted(r.Text for r in source.read_csv(spark, str(folder)).collect()) == ["first", "second"]
    (folder / "b.csv").write_text("Text,Id,Score\nsecond,2,4\n")
    with pytest.raises(ValueError, match="different headers"):  # before any row is read
        source.read_csv(spark, str(folder), multi_line=False)
    (folder / "b.csv").unlink()
    with gzip.open(folder / "c.csv.gz", "wt") as f:
        f.write("Id,Score,Text\n3,4,third\n")
    assert sorted(r.Text for r in source.read_csv(spark, str(folder)).collect()) == ["first", "third"]


def test_files_are_split_unless_a_quoted_field_holds_a_line_break(spark, tmp_path, recwarn):
    plain = tmp_path / "plain.csv"
    plain.write_text("Id,Score,Text\n" + "".join(f'{i},5,"text ""{i}"", and so on"\n' for i in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = source.read_csv(spark, str(plain))
        assert got.rdd.getNumPartitions() > 4 and not recwarn.list
        assert got.where("Text = 'text \"77\", and so on'").count() == 1 and got.count() == 5000
        plain.write_text(plain.read_text() + '5000,1,"two\nlines"\n')
        with pytest.warns(UserWarning, match="2 lines end inside a quoted field"):
            got = source.read_csv(spark, str(plain))
        assert got.rdd.getNumPartitions() == 1 and got.where("Text = 'two\nlines'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_reviews_are_dealt_out_only_when_asked(spark, sf):
    raw = source.reviews_from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    plain, dealt = source.load_reviews(raw), source.load_reviews(raw, spread=5)
    assert plain.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 5
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))


def test_a_machine_local_folder_is_refused_on_a_cluster(spark):
    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = conf

    unset = {"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077", **unset))
    assert shared_folder(Session("local[2]", **unset)) == "file:/home/x/spark-warehouse"
    assert shared_folder(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_folder(Session("yarn", **unset, **{"spark.checkpoint.dir": "file:/nfs/a"})) == "file:/nfs/a"


def test_stars_keep_their_fractions(spark, tmp_path):
    raw = load(spark, tmp_path, "Id,Score,Text\n1,2.5,a\n2,3.9,b\n3,4.5,c\n")
    scored = sentiment.score(source.load_reviews(raw), {})
    assert [r.ExpectedSentiment for r in scored.orderBy("Id").collect()] == [
        "Neutral", "Neutral", "Positive"]
    assert metrics.kpi(metrics.class_cube(scored)).first().avg_rating == 10.9 / 3


def test_rows_without_an_id_get_one_for_good(spark, tmp_path):
    loaded = source.load_reviews(load(spark, tmp_path, "Text,Score\n" + "x,1\n" * 50))
    ids = {r.Id for r in loaded.repartition(7).collect()}
    assert len(ids) == 50 and ids == {r.Id for r in loaded.collect()}


def test_a_table_is_a_stream_as_file_and_as_folder(spark, tmp_path):
    rows = spark.range(20)
    rows.repartition(3).write.parquet(str(tmp_path / "folder/t.parquet"))
    rows.toPandas().to_parquet(tmp_path / "t.parquet")
    for folder in (tmp_path, tmp_path / "folder"):
        stream = table_stream(spark, str(folder), "t.parquet")
        query = stream.writeStream.format("memory").queryName("t").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("t").count() == 20
