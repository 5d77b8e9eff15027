"""Entity resolution: a name's key by exact, partial, then fuzzy search, never guessing between candidates.

Index: one row a name with its search key, and one a (name, token), cached DataFrames built on first
use. Each step of the cascade is one small job that filters and ranks on the executors; only the best
candidates (at most 25) and a count come to the driver.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.functions.text import has_cjk, normalize, normalized, osa_column
from tarnspark.sources.star import Star

MAX_QUERY, MAX_KEY = 200, 400
MIN_PARTIAL, MIN_PARTIAL_CJK, MIN_FUZZY, MIN_TOKEN = 3, 2, 4, 3
NEIGHBOURS = 50
CANDIDATES, CANDIDATES_MOST = 10, 25

#: Kinds with their table, key and label columns.
KINDS = {"filme": ("dim_movies", "sk_movie_id", "titulo"), "pessoa": ("dim_people", "sk_person_id", "nome_pessoa"), "genero": ("dim_genres", "sk_genre_id", "nome_genero"), "produtora": ("dim_companies", "sk_company_id", "nome_produtora")}
#: Names by which the roles are asked for.
ROLES = {"diretor": "Diretor", "diretora": "Diretor", "director": "Diretor", "ator": "Ator", "atriz": "Ator", "actor": "Ator", "actress": "Ator", "roteirista": "Roteirista", "writer": "Roteirista", "screenwriter": "Roteirista"}
#: Other names of genres, with the genre's name in the source.
GENRE_NAMES = {
    "Ação": "Action", "Aventura": "Adventure", "Animação": "Animation", "Comédia": "Comedy", "Documentário": "Documentary", "Família": "Family", "Fantasia": "Fantasy", "História": "History", "Terror": "Horror", "Música": "Music",
    "Mistério": "Mystery", "Ficção científica": "Science Fiction", "Sci-Fi": "Science Fiction", "SciFi": "Science Fiction", "Suspense": "Thriller", "Cinema TV": "Tv Movie", "Filme de TV": "Tv Movie", "Guerra": "War", "Faroeste": "Western",
}


class EntityError(RuntimeError):
    """A kind could not be loaded; nothing of it is kept, and a retry loads it anew."""


@dataclass(frozen=True)
class Candidate:
    kind: str
    key: str
    label: str
    year: int | None = None
    movie_id: str | None = None
    role: str | None = None
    matched_via: str = "exact"
    edits: int | None = None


@dataclass(frozen=True)
class EntityMatch:
    """state: exact_unique, exact_multiple, partial_candidates, fuzzy_suggestions or none (with a reason).

    total_matches counts every match, so total_is_lower_bound is never set; callers may still read it.
    """

    state: str
    kind: str
    query: str
    normalized_query: str
    candidates: tuple[Candidate, ...] = ()
    total_matches: int = 0
    total_is_lower_bound: bool = False
    resolved: Candidate | None = None
    reason: str | None = None
    detail: str | None = None


def canonical_order(kind: str) -> list[Column]:
    """Order among equal names, the same in every run."""
    if kind == "filme":
        number = F.col("movie_id").try_cast("decimal(38,0)")
        whole = F.col("movie_id").rlike(r"^[0-9]+$")
        return [F.col("year").isNull(), F.coalesce("year", F.lit(0)), (~F.coalesce(whole, F.lit(False))), F.when(whole, number), F.coalesce("movie_id", F.lit("")), F.col("id")]
    if kind == "pessoa":
        return [F.coalesce("role", F.lit("")), F.col("label"), F.col("id")]
    return [F.col("label"), F.col("id")]


def build_index(star: Star, kind: str) -> DataFrame:
    """id, label, key, year, movie_id, role, alias: usable names only."""
    table, id_, label = KINDS[kind]
    src = getattr(star, table)
    extra = {"year": F.lit(None).cast("int"), "movie_id": F.lit(None).cast("string"), "role": F.lit(None).cast("string")}
    if kind == "filme":
        extra |= {"year": F.col("ano_lancamento"), "movie_id": F.col("id_filme")}
    if kind == "pessoa":
        extra |= {"role": F.col("tipo_pessoa")}
    rows = src.select(F.col(id_).alias("id"), F.col(label).alias("label"), *[c.alias(n) for n, c in extra.items()]).where("id is not null and id <> '' and label is not null")
    rows = rows.withColumn("key", normalized(F.col("label"))).where("key <> ''").withColumn("alias", F.lit(False))
    if kind == "genero":
        pairs = {normalize(a): normalize(t) for a, t in reversed(GENRE_NAMES.items())}  # of two names with one key the first counts
        names = star.session.createDataFrame(sorted(pairs.items()), "akey string, target string")
        first = Window.partitionBy("akey").orderBy("label", "id")
        more = names.join(rows, F.col("target") == F.col("key")).join(rows.select(F.col("key").alias("akey")), "akey", "left_anti")
        more = more.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("key", F.col("akey")).withColumn("alias", F.lit(True))
        rows = rows.unionByName(more.select(rows.columns))
    return rows


def own_index(rows: DataFrame) -> DataFrame:
    """The index of a table with id and label and nothing else."""
    no = lambda kind: F.lit(None).cast(kind)
    named = rows.select(F.col("id").cast("string").alias("id"), "label").where("id is not null and id <> '' and label is not null")
    named = named.withColumn("year", no("int")).withColumn("movie_id", no("string")).withColumn("role", no("string"))
    return named.withColumn("key", normalized(F.col("label"))).where("key <> ''").withColumn("alias", F.lit(False))


class EntityIndex:
    """Lookups by name over a star; kinds load on first use, whole or not at all."""

    def __init__(self, star: Star | None, frames: dict[str, DataFrame] | None = None):
        """Over a star, or over tables of one's own: kind -> DataFrame with id and label."""
        self.star, self.frames = star, frames or {}
        self._lock = threading.Lock()
        self._names: dict[str, DataFrame] = {}
        self._tokens: dict[str, DataFrame] = {}

    def names(self, kind: str) -> DataFrame:
        with self._lock:
            if kind not in self._names:
                rows = (own_index(self.frames[kind]) if kind in self.frames else build_index(self.star, kind)).cache()
                try:
                    n = rows.count()
                except Exception as e:
                    rows.unpersist()
                    raise EntityError(f"{kind}: the names cannot be read") from e
                if not n:
                    rows.unpersist()
                    raise EntityError(f"{kind}: the source has no names")
                self._names[kind] = rows
            return self._names[kind]

    def tokens(self, kind: str) -> DataFrame:
        """key, token: the distinct tokens of each distinct key."""
        names = self.names(kind)
        with self._lock:
            if kind not in self._tokens:
                self._tokens[kind] = names.select("key").distinct().select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("token")).cache()
            return self._tokens[kind]

    def find(self, kind: object, query: str, role: object = None, max_candidates: int = CANDIDATES) -> EntityMatch:
        kind, role = kind if kind in self.frames else parse_kind(kind), parse_role(role)
        if isinstance(max_candidates, bool) or not isinstance(max_candidates, int) or not 1 <= max_candidates <= CANDIDATES_MOST:
            raise ValueError(f"max_candidates must be a whole number from 1 to {CANDIDATES_MOST}")
        if role and kind != "pessoa":
            raise ValueError("only people have roles")
        none = lambda key, reason, detail=None: EntityMatch("none", kind, query[:MAX_QUERY], key, reason=reason, detail=detail)
        if bad := unusable(query):
            return none("", bad)
        key = normalize(query)
        if not key:
            return none("", "empty")
        if len(key) > MAX_KEY:
            return none("", "too_long")
        names = self.names(kind)
        mine = names.where(F.col("role") == role) if role else names
        exact = mine.where(F.col("key") == key).withColumn("via", F.when(F.col("alias"), "alias").otherwise("exact")).withColumn("edits", F.lit(None).cast("int"))
        if n := exact.count():
            found = self._best(kind, exact, canonical_order(kind), max_candidates)
            state = "exact_unique" if n == 1 else "exact_multiple"
            return EntityMatch(state, kind, query, key, found, n, resolved=found[0] if n == 1 else None)
        if role:
            others = sorted(r[0] for r in names.where(F.col("key") == key).select("role").distinct().collect() if r[0])
            if others:
                return none(key, "exists_in_other_role", ", ".join(others))
        short = len(key) < (MIN_PARTIAL_CJK if has_cjk(key) else MIN_PARTIAL)
        if not short:
            found, n = self._partial(kind, mine, key, max_candidates)
            if n:
                return EntityMatch("partial_candidates", kind, query, key, found, n)
        if len(key) >= MIN_FUZZY:
            found, n = self._fuzzy(kind, mine, key, max_candidates)
            if n:
                return EntityMatch("fuzzy_suggestions", kind, query, key, found, n)
        return none(key, "too_short_for_partial" if short else "no_match")

    def _best(self, kind: str, rows: DataFrame, order: list, k: int) -> tuple[Candidate, ...]:
        """The k best rows, each entity once."""
        w = Window.partitionBy("id").orderBy(*order)
        top = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").orderBy(*order).limit(k)
        return tuple(Candidate(kind, r["id"], r["label"], r["year"], r["movie_id"], r["role"], r["via"], r["edits"]) for r in top.collect())

    def _partial(self, kind: str, mine: DataFrame, key: str, k: int) -> tuple[tuple[Candidate, ...], int]:
        tokens = list(dict.fromkeys(key.split(" ")))
        # a beginning shorter than MIN_TOKEN counts only as a whole token
        fits = [F.col("token").startswith(t) if len(t) >= MIN_TOKEN else F.col("token") == t for t in tokens]
        hits = [F.max(F.when(F.col("token") == t, 2).when(fit, 1).otherwise(0)).alias(f"h{i}") for i, (t, fit) in enumerate(zip(tokens, fits))]
        # only tokens that may answer are grouped; keys that begin as the query does are found by themselves
        by = self.tokens(kind).where(reduce(lambda a, b: a | b, fits)).groupBy("key").agg(*hits)
        least = reduce(lambda a, b: F.least(a, b), [F.col(f"h{i}") for i in range(1, len(tokens))], F.col("h0"))
        by_token = by.withColumn("cls", F.when(least == 2, 1).when(least == 1, 2)).where("cls is not null").select("key", "cls")
        begins = self.names(kind).where(F.col("key").startswith(key)).select("key", F.lit(0).alias("cls"))
        found = by_token.unionByName(begins).groupBy("key").agg(F.min("cls").alias("cls"))
        matched = found.select("key", "cls", (F.size(F.array_distinct(F.split("key", " "))) - len(tokens)).alias("extra"))
        rows = mine.join(matched, "key").withColumn("via", F.when(F.col("alias"), "alias").when(F.col("cls") == 0, "prefix").otherwise("tokens")).withColumn("edits", F.lit(None).cast("int"))
        n = rows.select("id").distinct().count()
        order = [F.col("cls"), F.col("extra"), F.length("key"), F.col("key"), *canonical_order(kind)]
        return (self._best(kind, rows, order, k) if n else ()), n

    def _fuzzy(self, kind: str, mine: DataFrame, key: str, k: int) -> tuple[tuple[Candidate, ...], int]:
        tokens = list(dict.fromkeys(key.split(" ")))
        vocabulary = self.tokens(kind).select("token").distinct()
        near: DataFrame | None = None
        for i, t in enumerate(tokens):
            if len(t) < MIN_TOKEN:
                part = vocabulary.where(F.col("token") == t).withColumn("e", F.lit(0))
            else:
                limit = 1 if len(t) <= 5 else 2
                shape = F.length("token").between(len(t) - limit, len(t) + limit) & (F.col("token").startswith(t[0]) | F.col("token").endswith(t[-1]))
                part = vocabulary.where(shape).withColumn("e", osa_column(F.col("token"), t, limit)).where("e is not null").orderBy("e", "token").limit(NEIGHBOURS)
            part = part.withColumn("i", F.lit(i))
            near = part if near is None else near.unionByName(part)
        by = self.tokens(kind).join(near, "token").groupBy("key", "i").agg(F.min("e").alias("e"))
        by = by.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("e").cast("int").alias("edits"), F.count_if(F.col("e") == 0).alias("same")).where(F.col("c") == len(tokens))
        rows = mine.join(by, "key").withColumn("via", F.lit("fuzzy")).withColumn("extra", F.size(F.array_distinct(F.split("key", " "))) - len(tokens))
        n = rows.select("id").distinct().count()
        order = [F.col("edits"), -F.col("same"), F.col("extra"), F.length("key"), F.col("key"), *canonical_order(kind)]
        return (self._best(kind, rows, order, k) if n else ()), n


def parse_kind(kind: object) -> str:
    found = normalize(kind) if isinstance(kind, str) else ""
    if found not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    return found


def parse_role(role: object) -> str | None:
    if role is None:
        return None
    found = ROLES.get(normalize(role)) if isinstance(role, str) else None
    if not found:
        raise ValueError(f"role must be one of {', '.join(sorted(set(ROLES.values())))}")
    return found


def unusable(query: str) -> str | None:
    if len(query) > MAX_QUERY:
        return "too_long"
    try:
        query.encode()
    except UnicodeEncodeError:
        return "invalid_text"
    return "invalid_text" if "\0" in query else None
