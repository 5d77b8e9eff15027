"""The star schema: fixed tables, explicit types, hidden columns, validation at open."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnspark.errors import SourceUnavailable
from tarnspark.session import harden

_MONEY = "decimal(18,2)"
#: The readable tables, their columns and types.
TABLES: dict[str, dict[str, str]] = {
    "dim_movies": {"sk_movie_id": "string", "id_filme": "string", "titulo": "string", "data_lancamento": "date", "ano_lancamento": "int", "duracao_minutos": "int", "idioma_original": "string", "status_filme": "string", "sinopse": "string", "url_poster": "string", "url_backdrop": "string"},
    "fact_movies_performance": {"sk_movie_id": "string"} | {f"{m}_{c}": _MONEY for c in ("usd", "brl") for m in ("orcamento", "receita", "lucro")} | {"popularidade": "double", "nota_tmdb": "double", "qtd_tmdb": "int", "nota_imdb": "double", "qtd_imdb": "int"},
    "dim_genres": {"sk_genre_id": "string", "nome_genero": "string"},
    "dim_companies": {"sk_company_id": "string", "nome_produtora": "string"},
    "dim_people": {"sk_person_id": "string", "nome_pessoa": "string", "tipo_pessoa": "string"},
    "dim_reviews": {"sk_review_id": "string", "sk_movie_id": "string", "qtd_avaliacoes_usuarios": "int", "nota_media_usuarios": "double"},
    "movie_reviews": {"id": "int", "sk_movie_review_id": "string", "sk_movie_id": "string", "rating": "double", "text": "string", "created_at": "timestamp"},
    "bridge_movie_genre": {"sk_movie_id": "string", "sk_genre_id": "string"},
    "bridge_movie_person": {"sk_movie_id": "string", "sk_person_id": "string"},
    "bridge_movie_company": {"sk_movie_id": "string", "sk_company_id": "string"},
}
#: Columns that exist in storage and are never readable.
HIDDEN = {"movie_reviews": ("name",)}


def struct(table: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in TABLES[table].items()))


def missing_columns(table: str, df: DataFrame) -> list[str]:
    there = {c.lower() for c in df.columns}
    return [f"{table}.{c}" for c in TABLES[table] if c not in there]


def mistyped_columns(table: str, df: DataFrame) -> list[str]:
    """Columns whose type cannot stand for the declared one: only widening, text and date-time forms are cast."""
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    wrong = []
    for c, want in TABLES[table].items():
        have = kinds.get(c)
        family = next((f for f in _FAMILIES if want.split("(")[0] in f), ())
        if have is not None and have.typeName().split("(")[0] not in (*family, "void"):
            wrong.append(f"{table}.{c} ({have.simpleString()}, not {want})")
    return wrong


#: Type names that may stand for each other.
_FAMILIES = (("string", "char", "varchar"), ("int", "integer", "long", "short", "byte"), ("double", "float", "decimal", "integer", "long", "short", "byte"), ("decimal", "double", "float", "integer", "long", "short", "byte"), ("date",), ("timestamp", "timestamp_ntz", "date"))


@dataclass
class Star:
    """Tables by name, each projected to its readable columns and cast to its declared types."""

    session: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    _prints: dict[tuple, str] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def state(self) -> tuple:
        """Names, sizes and times of the files behind the tables; empty for tables that have none."""
        jvm, conf, out = self.session._jvm, self.session._jsc.hadoopConfiguration(), []
        for name in sorted(self.tables):
            for file in sorted(self.tables[name].inputFiles()):
                path = jvm.org.apache.hadoop.fs.Path(file)
                status = path.getFileSystem(conf).getFileStatus(path)
                out.append((name, file, status.getLen(), status.getModificationTime()))
        return tuple(out)

    def fingerprint(self) -> str:
        """SHA-256 over a hash of every table's rows, free of row order; read again only when a file has changed."""
        from pyspark.sql import functions as F

        state = self.state()
        if state and state in self._prints:
            return self._prints[state]
        out = hashlib.sha256()
        for name in sorted(self.tables):
            h = F.xxhash64(*self.tables[name].columns).cast("decimal(38,0)")
            out.update(f"{name}:{tuple(self.tables[name].agg(F.count(F.lit(1)), F.sum(h)).first())};".encode())
        self._prints = {state: out.hexdigest()}
        return self._prints[state]


def from_frames(spark: SparkSession, frames: dict[str, DataFrame]) -> Star:
    """Validate, project, cast and register; all or nothing, extra columns and tables stay hidden."""
    lost = [t for t in TABLES if t not in frames]
    lost += [c for t in TABLES if t in frames for c in missing_columns(t, frames[t])]
    if lost:
        more = f" and {len(lost) - 10} more" if len(lost) > 10 else ""
        raise SourceUnavailable(f"the source lacks {', '.join(lost[:10])}{more}", "open a source with the whole schema")
    wrong = [c for t in TABLES for c in mistyped_columns(t, frames[t])]
    if wrong:
        more = f" and {len(wrong) - 10} more" if len(wrong) > 10 else ""
        raise SourceUnavailable(f"the source has other types: {', '.join(wrong[:10])}{more}", "open a source with the declared types")
    own = harden(spark)
    star = Star(own)
    for t, cols in TABLES.items():
        # the view has the readable columns only, so even * cannot reach another
        view = frames[t].select(*[frames[t][c].cast(kind).alias(c) for c, kind in cols.items()])
        view = DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, view._jdf.logicalPlan()), own)
        view.createOrReplaceTempView(t)
        star.tables[t] = view
    return star


def open_parquet(spark: SparkSession, path: str) -> Star:
    """The ten tables as ``path``/name.parquet; errors name the folder's last part only."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    frames = {}
    for t in TABLES:
        try:
            frames[t] = spark.read.parquet(f"{path.rstrip('/')}/{t}.parquet")
        except AnalysisException as e:
            kind = "has no table" if "PATH_NOT_FOUND" in (e.getCondition() or "") else "cannot read table"
            raise SourceUnavailable(f"source {base!r} {kind} {t!r}") from None
        except PySparkException:
            raise SourceUnavailable(f"source {base!r}: table {t!r} is damaged or of another format") from None
    return from_frames(spark, frames)
