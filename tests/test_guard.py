"""What the guard admits and refuses, and how execution behaves."""

import time

import pytest

from tarnspark.errors import GuardedError, SourceUnavailable, StatementFailed, StatementRejected, StatementTimeout
from tarnspark.plans.executor import SafeExecutor, shorten
from tarnspark.plans.guard import quoted_values
from tarnspark.sources import star as S
from tests.catalogue import base

REFUSED = [
    "INSERT INTO dim_genres VALUES ('x', 'y')", "UPDATE dim_genres SET nome_genero = 'x'", "DELETE FROM dim_genres", "DROP VIEW dim_genres", "CREATE TABLE t AS SELECT 1", "ALTER TABLE dim_genres RENAME TO x", "SET spark.sql.ansi.enabled=false", "RESET", "SHOW TABLES",
    "DESCRIBE dim_genres", "CACHE TABLE dim_genres", "ADD JAR '/tmp/x.jar'", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "EXPLAIN SELECT 1", "USE x", "TRUNCATE TABLE dim_genres", "VACUUM", "PRAGMA x", "ATTACH 'x' AS y", "BEGIN", "COMMIT", "ROLLBACK", "",
    "SELECT 1; DROP VIEW dim_genres", "SELECT name FROM alembic_version", "SELECT * FROM parquet.`/etc/passwd`", "SELECT * FROM range(10)", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT input_file_name() FROM dim_genres",
    "SELECT rand()", "SELECT uuid()", "SELECT version()", "SELECT assert_true(false)", "SELECT current_date", "SELECT current_date()", "SELECT now()", "SELECT current_timestamp FROM dim_genres", "SELECT date('now')", "SELECT CAST('today' AS DATE)", "SELECT date()",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT * FROM t", "SELECT movie_reviews.name FROM movie_reviews", "SELECT * FROM other.dim_genres", "SELECT * FROM dim_genres WHERE sk_genre_id IN (SELECT x FROM hidden)", "SELECT (SELECT max(x) FROM hidden)",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret)", "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "SELECT * FROM (WITH s AS (SELECT 1 AS x) SELECT x FROM s) JOIN s",
    "SELECT 1 WHERE 1 IN secret", "SELECT timestamp'now'", "SELECT date 'today'", "SELECT timestamp_ntz 'tomorrow'", "SELECT DATE /* x */ 'yesterday'", "SELECT 'a' RLIKE 'a'", "SELECT * FROM [secret]", "SELECT date('2024-01-01', '+' || '1 day')", "SELECT date('2024-01-01', 'localtime')", "SELECT strftime('%Q', '2024-01-01')",
    "WITH dim AS (SELECT * FROM hidden) SELECT * FROM dim", "FROM dim_genres SELECT *", "TABLE dim_genres", "VALUES (1)", "SELECT explode(array(1))", "SELECT * FROM dim_genres TABLESAMPLE (10 PERCENT)", "SELECT transform(array(1), x -> x)",
]
ADMITTED = [
    ("SELECT 1 + 1 AS x", ((2,),)), ("select count(*) from DIM_GENRES;", ((19,),)), ("-- note\n/* more */ SELECT count(*) AS n FROM dim_movies", ((3,),)), ("WITH a AS (SELECT sk_movie_id FROM dim_movies), b AS (SELECT * FROM a) SELECT count(*) FROM b", ((3,),)),
    ("SELECT titulo FROM dim_movies WHERE sk_movie_id IN (SELECT sk_movie_id FROM fact_movies_performance WHERE receita_brl > 5) ORDER BY 1", (("B",),)), ("SELECT 1 AS a, 2 AS a", ((1, 2),)), ("SELECT iif(1 > 0, 'y', 'n')", (("y",),)), ("SELECT strftime('%Y/%m', TIMESTAMP '2020-02-03 00:00:00'), julianday(TIMESTAMP '2000-01-01 12:00:00'), glob('a*', 'abc'), 'iif(1)'", (("2020/02", 2451545.0, True, "iif(1)"),)),
    ("SELECT titulo, rank() OVER (ORDER BY ano_lancamento DESC NULLS LAST) AS p FROM dim_movies ORDER BY p, titulo LIMIT 1", (("B", 1),)), ("SELECT nome_genero FROM dim_genres WHERE nome_genero LIKE 'A%' UNION SELECT 'x' ORDER BY 1 DESC LIMIT 1", (("x",),)),
]


#: Expression -> value, as the dialect has it.
VALUES = [
    ("log(100.0)", 2.0), ("log(2, 8)", 3.0), ("log(-1)", None), ("7/2", 3), ("-7/2", -3), ("7/2.0", 3.5), ("1/0", None), ("1.0/0", None), ("(3+4)/(1+1)", 3), ("8/2/2", 2), ("7 % 3", 1), ("-7 % 3", -1), ("7 % 0", None), ("7.9 % 3", 1),
    ("'abc' LIKE 'AB%'", True), ("'ABC' NOT LIKE 'ab_'", False), ("'É' LIKE 'é'", False), ("'a%b' LIKE 'a!%b' ESCAPE '!'", True), ("'axb' LIKE 'a!%b' ESCAPE '!'", False), ("'a\\\\b' LIKE 'a\\\\%'", True), ("like('AB%', 'abc')", True), ("NULL LIKE 'a'", None), ("10 LIKE '1%'", True),
    ("'abc' GLOB 'a*'", True), ("'abc' GLOB 'A*'", False), ("'axb' NOT GLOB 'a.b'", True), ("glob('a.b', 'axb')", False), ("glob('a.b', 'a.b')", True), ("glob('[a-c]?z', 'bxz')", True), ("glob('[^a-c]*', 'bxz')", False), ("glob('a' || '.[b^]*', 'a.^(')", True), ("glob('a' || '+', 'aa')", False), ("glob('a$|(b)', 'a$|(b)')", True),
    ("substr('abcdef', 0, 3)", "ab"), ("substr('abcdef', 2, 3)", "bcd"), ("substr('abcdef', -2)", "ef"), ("substr('abcdef', 4, -2)", "bc"), ("substring('abcdef', -1, -2)", "de"), ("substr('abcdef', 2, -5)", "a"), ("substr('abc', -5, 3)", "a"),
    ("ltrim('xxabc', 'x')", "abc"), ("rtrim('abcxy', 'yx')", "abc"), ("trim('xaby', 'yx')", "ab"), ("trim('  a ')", "a"), ("ltrim('a]b', ']a')", "b"),
    ("typeof(1)", "integer"), ("typeof(1.5)", "real"), ("typeof('x')", "text"), ("typeof(NULL)", "null"), ("typeof(CAST('x' AS BLOB))", "blob"),
    ("concat('a', NULL)", "a"), ("concat('a', 1, 'b')", "a1b"), ("concat_ws('-', 'a', NULL, 'b')", "a-b"), ("'a' || NULL", None), ("'a' || 'b'", "ab"),
    ("sqrt(-1.0)", None), ("sqrt(9)", 3.0), ("upper('éa')", "éA"), ("lower('ÉA')", "Éa"), ("trunc(2.7)", 2), ("trunc(-2.7)", -2), ("mod(7, 3)", 1.0), ("mod(7, 0)", None), ("round(2.5)", 3.0), ("round(2.345, 2)", 2.35), ("sign(-3)", -1), ("ceil(1.2)", 2), ("ceiling(1.2)", 2), ("floor(-1.2)", -2),
    ("max(1, 2, 3)", 3), ("min(1, 2, 3)", 1), ("max(1, NULL)", None), ("iif(1 > 2, 'y', 'n')", "n"), ("ifnull(NULL, 2)", 2), ("nullif(1, 1)", None), ("coalesce(NULL, 3)", 3), ("abs(-2)", 2), ("length('abc')", 3), ("instr('abc', 'c')", 3), ("replace('aba', 'a', 'x')", "xbx"),
    ("pow(2, 3)", 8.0), ("power(2, 3)", 8.0), ("exp(0)", 1.0), ("ln(1)", 0.0), ("log10(1000)", 3.0), ("log2(8)", 3.0),
    ("CAST('abc' AS REAL)", 0.0), ("CAST('1.5x' AS REAL)", 1.5), ("CAST('12ab' AS INTEGER)", 12), ("CAST('abc' AS INTEGER)", 0), ("CAST(2.7 AS INTEGER)", 2), ("CAST(NULL AS INTEGER)", None), ("CAST(12 AS TEXT)", "12"), ("CAST(0.1 AS REAL)", 0.1), ("'10' = 10", False), ("10 < '9'", True), ("'9' > 10", True), ("'a' = 'a'", True), ("10 = 10.0", True),
    ("date('2024-01-31')", "2024-01-31"), ("date('2024-01-31', '+1 month')", "2024-03-02"), ("date('2024-02-29', '+1 year')", "2025-03-01"), ("date('2024-03-15', 'start of month', '-1 day')", "2024-02-29"), ("date('2024-11-26', 'weekday 0')", "2024-12-01"), ("date('nonsense')", None), ("date('n' || 'ow')", None), ("CAST('to' || 'day' AS DATE)", None),
    ("time('2024-01-31 10:20:30')", "10:20:30"), ("datetime('2024-01-31 10:20:30', '+90 minutes')", "2024-01-31 11:50:30"), ("strftime('%w', '2024-11-26')", "2"), ("strftime('%Y/%m/%d it''s %H%%', '2024-11-26 07:00:00')", "2024/11/26 it's 07%"), ("strftime('%j', '2024-02-01')", "032"), ("julianday('2000-01-01 12:00:00')", 2451545.0), ("unixepoch('1970-01-02')", 86400), ("date(TIMESTAMP '2020-02-03 00:00:00')", "2020-02-03"),
]
#: Statement over the catalogue -> rows.
STATEMENTS = [
    ("SELECT total(duracao_minutos) FROM dim_movies WHERE 1 = 0", ((0.0,),)), ("SELECT total(ano_lancamento), total(DISTINCT ano_lancamento) FILTER (WHERE ano_lancamento > 2005) FROM dim_movies", ((4010.0, 2010.0),)),
    ("SELECT group_concat(titulo) FROM dim_movies WHERE ano_lancamento > 0", (("A,B",),)), ("SELECT group_concat(DISTINCT titulo, ' - ') FROM dim_movies WHERE length(titulo) = 1", (("A - B",),)), ("SELECT string_agg(titulo, '; ') FROM dim_movies WHERE ano_lancamento > 0", (("A; B",),)), ("SELECT group_concat(titulo) FROM dim_movies WHERE 1 = 0", ((None,),)),
    ("SELECT titulo, group_concat(titulo) OVER (ORDER BY titulo) AS g, total(ano_lancamento) OVER () AS t FROM dim_movies WHERE ano_lancamento > 0 ORDER BY 1", (("A", "A", 4010.0), ("B", "A,B", 4010.0))), ("SELECT max(ano_lancamento), min(ano_lancamento) FROM dim_movies", ((2010, 2000),)),
    ("WITH w AS (SELECT sk_movie_id FROM dim_movies WHERE ano_lancamento > 2005) SELECT titulo FROM dim_movies WHERE sk_movie_id IN w", (("B",),)), ("SELECT titulo FROM dim_movies WHERE sk_movie_id NOT IN (SELECT sk_movie_id FROM fact_movies_performance WHERE receita_brl > 5) AND ano_lancamento / 3 = 666", (("A",),)),
    ("SELECT [titulo] AS [the title] FROM [dim_movies] m WHERE m.[ano_lancamento] = 2000", (("A",),)), ("SELECT titulo FROM dim_movies WHERE titulo LIKE 'a' OR titulo GLOB '[B-C]' ORDER BY titulo", (("A",), ("B",))), ("SELECT ano_lancamento / 1000 AS k, count(*) FROM dim_movies WHERE ano_lancamento > 0 GROUP BY ano_lancamento / 1000 HAVING count(*) / 2 = 1", ((2, 2),)),
    ("SELECT (SELECT max(7 / 2, 1)) AS x, CASE WHEN 'b' LIKE 'B' THEN log(10) END AS y", ((3, 1.0),)), ("WITH a AS (SELECT 7 / 2 AS x), b AS (SELECT x FROM a) SELECT x FROM (SELECT x FROM b) WHERE x = 3", ((3,),)), ("SELECT 5 / 2 AS x UNION ALL SELECT 7 / 2 ORDER BY 1", ((2,), (3,))), ("SELECT titulo FROM dim_movies a WHERE EXISTS (SELECT 1 FROM dim_movies b WHERE b.ano_lancamento / 2 = 1005 AND a.titulo = b.titulo)", (("B",),)),
]


@pytest.fixture(scope="module")
def box(spark):
    r = base()
    r.film(1, "A", year=2000, receita_brl=1)
    r.film(2, "B", year=2010, receita_brl=10)
    r.film(3, "C" * 1200)
    star = r.star(spark)
    return SafeExecutor(star.session, max_rows=50)


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(box, sql):
    for spelling in (sql, f"  ;/* x */ {sql}", sql.swapcase() if "'" not in sql and "`" not in sql else sql):
        with pytest.raises(GuardedError):
            box.execute(spelling)


@pytest.mark.parametrize("sql,rows", ADMITTED)
def test_admitted(box, sql, rows):
    assert box.execute(sql).rows == rows


@pytest.mark.parametrize("part", range(8))
def test_values_of_the_dialect(box, part):
    some = VALUES[part::8]
    got = box.execute("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(some))).rows[0]
    for (e, want), x in zip(some, got):
        assert x == want if not isinstance(want, float) or x is None else abs(float(x) - want) < 1e-9, (e, x, want)
        assert (x is None) == (want is None), (e, x)


@pytest.mark.parametrize("sql,rows", STATEMENTS)
def test_statements_of_the_dialect(box, sql, rows):
    assert box.execute(sql).rows == rows


def test_column_names_are_as_written(box):
    assert box.execute("SELECT 7/2, lower(titulo), titulo FROM dim_movies").columns == ("7/2", "lower(titulo)", "titulo")


def test_interrupt_passes_through(box, monkeypatch):
    """A Ctrl+C before the deadline is the user's, not a timeout; the next statement runs."""

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("pyspark.sql.DataFrame.take", stop)
        m.setattr("pyspark.sql.classic.dataframe.DataFrame.take", stop)
        with pytest.raises(KeyboardInterrupt):
            box.execute("SELECT 1")
    assert box.execute("SELECT 1").rows == ((1,),)


def test_patterns_known_at_run_time_are_bounded(box):
    with pytest.raises(GuardedError, match="pattern"):
        box.execute("SELECT 'a' LIKE titulo || titulo FROM dim_movies")


def test_text_limits(box):
    for bad in (None, 5, "SELECT 1\0", "SELECT '\ud800'", "SELECT '" + "x" * 20_001 + "'"):
        with pytest.raises(StatementRejected):
            box.execute(bad)
    with pytest.raises(StatementRejected):
        box.execute("SELECT " + ", ".join(f"{i} AS c{i}" for i in range(101)))
    with pytest.raises(StatementRejected):
        box.execute(" UNION ALL ".join(["SELECT 1"] * 22))


def test_caps(box):
    r = box.execute("SELECT sk_genre_id FROM dim_genres", max_rows=5)
    assert r.truncated and len(r.rows) == 5
    assert not box.execute("SELECT sk_genre_id FROM dim_genres", max_rows=19).truncated
    r = box.execute("SELECT titulo FROM dim_movies WHERE sk_movie_id = 'm3'")
    assert r.truncated_cells == 1 and r.rows[0][0].endswith("… [+200 characters]")
    assert shorten(b"abc") == ("<3 bytes>", False)
    for bad in (0, True, 10**6 + 1, 1.5):
        with pytest.raises(ValueError):
            box.execute("SELECT 1", max_rows=bad)
    for bad in (0, float("nan"), float("inf"), 3601, True):
        with pytest.raises(ValueError):
            box.execute("SELECT 1", timeout_s=bad)


def test_hidden_column_is_not_there(box):
    with pytest.raises(GuardedError):
        box.execute("SELECT name FROM movie_reviews")
    assert "name" not in box.execute("SELECT * FROM movie_reviews").columns


def test_errors_say_what_to_do(box):
    with pytest.raises(StatementRejected, match="did you mean.*dim_genres"):
        box.execute("SELECT 1 FROM dim_genre")
    with pytest.raises(StatementFailed, match="no column") as e:
        box.execute("SELECT nome_gener FROM dim_genres")
    assert "nome_genero" in e.value.hint
    with pytest.raises(StatementFailed, match="ambiguous"):
        box.execute("SELECT sk_movie_id FROM dim_movies a JOIN fact_movies_performance b ON a.sk_movie_id = b.sk_movie_id")
    with pytest.raises(StatementFailed) as e:
        box.execute('SELECT 1 FROM dim_genres WHERE nome_genero = "Drama"')
    assert "single quotes" in e.value.hint
    assert quoted_values("""SELECT "a" FROM t WHERE x = "b" AND y IN ("c", 'd') AND "z" > 1""") == ["b", "c"]


def test_deadline_and_after(box):
    began = time.monotonic()
    with pytest.raises(StatementTimeout):
        box.execute("SELECT count(*) FROM " + ", ".join(f"dim_genres g{i}" for i in range(9)), timeout_s=2)
    assert time.monotonic() - began < 20
    assert box.execute("SELECT 1").rows == ((1,),)


def test_source_is_validated(spark, tmp_path):
    r = base()
    frames = {t: spark.createDataFrame([], S.struct(t)) for t in S.TABLES}
    with pytest.raises(SourceUnavailable, match="dim_genres.nome_genero"):
        S.from_frames(spark, frames | {"dim_genres": frames["dim_genres"].drop("nome_genero")})
    with pytest.raises(SourceUnavailable, match=r"dim_movies.ano_lancamento \(string, not int\)"):
        S.from_frames(spark, frames | {"dim_movies": frames["dim_movies"].withColumn("ano_lancamento", frames["dim_movies"]["titulo"])})
    with pytest.raises(SourceUnavailable) as e:
        S.open_parquet(spark, str(tmp_path / "nothing"))
    assert str(tmp_path) not in str(e.value) and not e.value.recoverable
    star = r.star(spark)
    assert star.fingerprint() == r.star(spark, shuffle=3).fingerprint()
    for t in S.TABLES:
        star.tables[t].write.parquet(str(tmp_path / "gold" / f"{t}.parquet"))
    gold = S.open_parquet(spark, str(tmp_path / "gold"))
    assert gold.dim_genres.count() == 19 and gold.fingerprint() == star.fingerprint()
    assert gold.state() and gold._prints == {gold.state(): gold.fingerprint()}
