"""Readers, parsers and sinks on small hand-written inputs."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kickframe.operators import cleaning as cl
from kickframe.session import scratch_path, shared_dir
from kickframe.sources import feeds as fd
from kickframe.sources import matchtext as mt
from kickframe.sources import seasonfiles as sf
from kickframe.sources import stores as st

DOC = """= Cup
# note
▪ Group A
Tue Sep 17 2024
  18:45  Alpha FC (ENG) v Beta (ESP)  0-3 (0-2)
         Gamma v Delta  0-0
Wed Jan 15
  20:00  Alpha FC (ENG) v Gamma  4-1 a.e.t. (1-1, 0-1)
         Beta (ESP) v Delta  4-1 a.e.t. (1-1)
         Delta v Alpha FC (ENG)  3-4 pen. 1-1 a.e.t. (1-1, 0-0)
         Gamma v Beta (ESP)  4-2 pen. 1-1 a.e.t. (1-1)
         Gamma v Alpha FC (ENG)  3-0 awarded
         Gamma v Delta  cancelled
         Gamma v Delta"""


def test_every_score_notation(spark):
    docs = spark.createDataFrame([("d", "CL", "2024-25", 2024, 2025, DOC)], "doc_id string, competition string, season string, start_year int, end_year int, text string")
    got = [(str(r.match_date), r.home_team, r.away_team, r.fthg, r.ftag, r.hthg, r.htag) for r in mt.parse_match_text(docs).collect()]
    assert sorted(got, key=repr) == sorted([
        ("2024-09-17", "Alpha FC", "Beta", 0, 3, 0, 2), ("2024-09-17", "Gamma", "Delta", 0, 0, None, None),
        ("2025-01-15", "Alpha FC", "Gamma", 1, 1, 0, 1), ("2025-01-15", "Beta", "Delta", 1, 1, None, None),
        ("2025-01-15", "Delta", "Alpha FC", 1, 1, 0, 0), ("2025-01-15", "Gamma", "Beta", 1, 1, None, None)], key=repr)


def test_tabs_part_as_blanks_do(spark):
    schema = "doc_id string, competition string, season string, start_year int, end_year int, text string"
    tabbed = DOC.replace("  ", "\t").replace(" v ", "\tv\t").replace("Wed Jan", "Wed\tJan")
    docs = [spark.createDataFrame([("d", "CL", "2024-25", 2024, 2025, text)], schema) for text in (DOC, tabbed)]
    plain, other = (sorted(map(repr, mt.parse_match_text(d).collect())) for d in docs)
    assert plain == other and len(plain) == 6


def test_season_files_with_other_headers_encodings_and_bad_lines(spark, tmp_path):
    (tmp_path / "2425_E0.csv").write_bytes("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HxG\nE0,17/08/2024,A,B,1,0,H,1.2\nE0,18/08/2024,C,D,1,1,D,1,2,3\n".encode())
    (tmp_path / "2425_SP1.csv").write_bytes("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nSP1,17/08/2024,Málaga,E,0,0,D\nSP1,18/08/2024,F,G\n".encode("latin-1"))
    got = {(r.league_code, r.season, r.home_team, r.fthg) for r in sf.read_season_csv(spark, str(tmp_path)).collect()}
    assert got == {("E0", "2425", "A", "1"), ("SP1", "2425", "Málaga", "0"), ("SP1", "2425", "F", None)}


def test_division_guard_rejects_another_division(spark):
    df = spark.createDataFrame([("f1", "E0", "E0"), ("f1", "E0", " E0 "), ("f2", "SP1", "SC1"), ("f3", "D1", None), ("f4", "I1", "I1"), ("f4", "I1", "I2")],
                               "file string, league_code string, div string")
    assert {r.file for r in sf.division_guard(df).collect()} == {"f1", "f3"}


def test_league_tables_replace_only_their_leagues(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([("A", "9596", 1), ("B", "9596", 2)], "league_code string, season string, match_id int")
    sf.write_league_parquet(both, path)
    sf.write_league_parquet(both.where("league_code = 'A'").withColumn("match_id", F.lit(9)), path)
    assert {(r.league_code, r.match_id) for r in spark.read.parquet(path).collect()} == {("A", 9), ("B", 2)}


def test_payloads_are_rows_however_large_a_day(spark):
    df = spark.range(1000).select(F.col("id").alias("match_id"), F.lit("L").alias("league_code"), F.lit("2020-01-01").cast("date").alias("match_date"))
    out = st.payloads(df)
    assert out.count() == 1000 and out.where("match_id = 7").first().payload == '{"match_id":7}'
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_prediction_upsert_keeps_other_keys(spark):
    path = scratch_path(spark, "upsert-test")
    schema = "match_id long, league_code string, match_date string, p double"
    def frame(data):
        return spark.createDataFrame(data, schema).withColumn("match_date", F.to_date("match_date"))
    st.write_predictions(frame([(1, "A", "2020-01-01", 0.1), (2, "B", "2020-01-01", 0.2), (3, "A", "2020-02-01", 0.3)]), path)
    st.write_predictions(frame([(4, "A", "2020-01-01", 0.9)]), path)
    got = {(r.match_id, r.p) for r in st.read_predictions(spark, path, "match_id long, p double").collect()}
    assert got == {(4, 0.9), (2, 0.2), (3, 0.3)}


def test_unify_dtypes_needs_every_value(spark):
    df = spark.createDataFrame([("1", "2", None), ("3", "x", None)], "a string, b string, c string")
    assert dict(cl.unify_dtypes(df).dtypes) == {"a": "double", "b": "string", "c": "double"}


def test_clean_matches_reads_three_date_forms(spark):
    df = spark.createDataFrame([("17/08/2024", "H"), ("17/08/24", "D"), ("2024-08-17", "A"), ("99/99/2024", "H"), ("17/08/2024", "?")], "match_date string, ftr string")
    got = [(str(r.match_date), r.result) for r in cl.clean_matches(df).collect()]
    assert sorted(got) == [("2024-08-17", 0), ("2024-08-17", 1), ("2024-08-17", 2)]


def test_malformed_odds_events_do_not_fail(spark):
    df = spark.createDataFrame([("{bad",), ('{"id":"1","commence_time":"soon","home_team":"a","away_team":"b"}',)], "payload string")
    _, fixtures = fd.parse_odds_events(df)
    assert fixtures.count() == 0


def test_first_header_counts_and_quoted_commas_end_no_field(spark, tmp_path):
    folder = tmp_path / "season=9596"
    folder.mkdir()
    (folder / "9596_E0.csv").write_text('Div,HomeTeam,AwayTeam\nE0,"a, b",c\nE0,zz HomeTeam FC,d\nE0,too,many,fields\n')
    got = {(r.home_team, r.away_team) for r in sf.read_season_csv(spark, str(tmp_path)).collect()}
    assert got == {("a, b", "c"), ("zz HomeTeam FC", "d")}


def test_missing_shared_folder_is_an_error_off_local_masters():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="shared folder"):
        shared_dir(Session())


def test_books_travel_as_prices(spark, small):
    """Quotes are gathered before teams and outcome names are beside them, and every match has its event."""
    from kickframe.sources.synthetic import matches, quotes
    from kickframe.workload import sources

    events = sources.odds_events(spark, small)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and events.count() == matches(spark, small).count()
    got = {(r.id, r.source, r.outcome): r.price for r in fd.parse_odds_events(events)[0].collect()}
    want = {(str(r.match_id), r.source, side): r[f"odds_{side}"] for r in quotes(spark, small).join(matches(spark, small), "match_id").collect()
            for side in ("home", "draw", "away")}
    assert got == want
