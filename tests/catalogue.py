"""Small star catalogues, random and made by hand, and plain-Python answers to the reference queries."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

from tarnspark.sources import star as S

GENRES = ["Action", "Adventure", "Animation", "Comedy", "Crime", "Documentary", "Drama", "Family", "Fantasy", "History", "Horror", "Music", "Mystery", "Romance", "Science Fiction", "Thriller", "Tv Movie", "War", "Western"]


class Rows(defaultdict):
    """table -> list of dicts; columns left out are null."""

    def __init__(self):
        super().__init__(list)

    def film(self, i, titulo=None, *, year=None, day=None, status="Lançado", genres=(), people=(), companies=(), reviews=None, **fact):
        sk = f"m{i}"
        self["dim_movies"].append({"sk_movie_id": sk, "id_filme": str(i), "titulo": titulo or f"Film {i}", "ano_lancamento": year, "data_lancamento": day, "status_filme": status})
        if fact:
            fact = {k: (Decimal(str(v)) if v is not None and k.rsplit("_", 1)[-1] in ("brl", "usd") else v) for k, v in fact.items()}
            if "lucro_brl" not in fact:
                fact["lucro_brl"] = (fact.get("receita_brl") or Decimal(0)) - (fact.get("orcamento_brl") or Decimal(0))
            self["fact_movies_performance"].append({"sk_movie_id": sk} | fact)
        for kind, col, keys in (("genre", "sk_genre_id", genres), ("person", "sk_person_id", people), ("company", "sk_company_id", companies)):
            for k in keys:
                self[f"bridge_movie_{kind}"].append({"sk_movie_id": sk, col: k})
        if reviews:
            self["dim_reviews"].append({"sk_review_id": f"r{i}", "sk_movie_id": sk, "qtd_avaliacoes_usuarios": reviews[0], "nota_media_usuarios": reviews[1]})
        return sk

    def star(self, spark, shuffle=None):
        frames = {}
        for t, cols in S.TABLES.items():
            rows = list(self[t])
            if shuffle is not None:
                random.Random(shuffle).shuffle(rows)
            frames[t] = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], S.struct(t))
        return S.from_frames(spark, frames)


def base() -> Rows:
    r = Rows()
    r["dim_genres"] = [{"sk_genre_id": f"g{i:02d}", "nome_genero": g} for i, g in enumerate(GENRES, 1)]
    r["dim_companies"] = [{"sk_company_id": f"c{i}", "nome_produtora": n} for i, n in enumerate(["Ghibli", "Café Filmes", "CAFE FILMES", "Pixar"], 1)]
    r["dim_people"] = [{"sk_person_id": f"p{i}", "nome_pessoa": f"Person {i // 2}", "tipo_pessoa": ("Ator", "Diretor")[i % 2]} for i in range(16)]
    return r


def random_catalogue(seed: int) -> Rows:
    """Values picked to tie, to be null or zero, and to stand at the window's edges."""
    rng, r = random.Random(seed), base()
    ref = date(2026, 10, 1)
    days = [ref, ref + timedelta(1), date(2021, 10, 1), date(2021, 9, 30), date(2023, 5, 5), None]
    for i in range(rng.randint(40, 60)):
        fact = {
            "receita_brl": rng.choice([None, 0, 100, 100.5, 300, 500, 1000]), "orcamento_brl": rng.choice([None, 0, 30, 70, 100, 250]), "receita_usd": rng.choice([None, 10, 20]), "popularidade": rng.choice([None, 0.0, 1.5, 9.25]),
            "nota_tmdb": rng.choice([None, 0.0, 6.904, 6.903999999999999, 9.2]), "qtd_tmdb": rng.choice([None, 0, 5]), "nota_imdb": rng.choice([None, 0.0, 5.1, 7.0, 9.200000000000001]), "qtd_imdb": 3,
        }
        day = rng.choice(days)
        r.film(
            i, rng.choice(["Silence", "Água", f"Film {i}"]), year=day.year if day else rng.choice([None, 2019]), day=day, status=rng.choice(["Lançado", "Lançado", "Rumored"]), genres=rng.sample([g["sk_genre_id"] for g in r["dim_genres"][:12]], rng.randint(0, 3)),
            people=rng.sample([p["sk_person_id"] for p in r["dim_people"]], rng.randint(0, 8)), companies=rng.sample(["c1", "c2", "c3", "c4"], rng.randint(0, 2)), reviews=rng.choice([None, (0, None), (3, 0.0), (3, 4.5), (9, 8.0)]), **(fact if rng.random() < 0.9 else {}),
        )
    return r


def ranked(pairs, n, digits):
    """[(place, item, value)] of the places up to n."""
    vals = [round(float(v), digits) for _, v in pairs]
    out = [(1 + sum(w > v for w in vals), item, v) for (item, _), v in zip(pairs, vals)]
    return [x for x in out if x[0] <= n]


def answers(r: Rows, reference: date) -> dict[str, list[tuple]]:
    """Plain answers: sets of (place, film id, value) or the like, by case."""
    films = {m["sk_movie_id"]: m for m in r["dim_movies"]}
    facts = {f["sk_movie_id"]: f for f in r["fact_movies_performance"]}
    genre = {g["sk_genre_id"]: g["nome_genero"] for g in r["dim_genres"]}
    who = {p["sk_person_id"]: p for p in r["dim_people"]}
    num = lambda f, c: None if f.get(c) is None else float(f[c])
    top = lambda pairs, n, d: sorted((p, films[k]["id_filme"], v) for p, k, v in ranked(pairs, n, d))
    out = {}
    out["q01"] = top([(k, num(f, "receita_brl")) for k, f in facts.items() if f.get("receita_brl") is not None], 10, 2)
    profits = defaultdict(list)
    for b in r["bridge_movie_genre"]:
        f = facts.get(b["sk_movie_id"])
        if f and f.get("receita_brl") is not None:
            profits[genre[b["sk_genre_id"]]].append(f["lucro_brl"])
    out["q02"] = sorted((g, len(v), round(float(sum(v) / len(v)), 2)) for g, v in profits.items())
    margin = {k: float((f["receita_brl"] - f["orcamento_brl"]) / f["receita_brl"]) for k, f in facts.items() if (f.get("receita_brl") or 0) > 0 and f.get("orcamento_brl") is not None}
    out["q03"] = top(list(margin.items()), 10, 12)
    out["q04"] = top([(k, f["popularidade"]) for k, f in facts.items() if f.get("popularidade") is not None], 5, 9)
    out["q05"] = top([(k, abs(f["nota_tmdb"] - f["nota_imdb"])) for k, f in facts.items() if (f.get("nota_imdb") or 0) > 0 and f.get("nota_tmdb") is not None and (f["nota_tmdb"] != 0 or (f.get("qtd_tmdb") or 0) > 0)], 10, 9)
    years = defaultdict(list)
    for k, f in facts.items():
        if (f.get("nota_imdb") or 0) > 0:
            years[films[k]["ano_lancamento"]].append(f["nota_imdb"])
    out["q06"] = sorted(((y or 0), len(v), round(sum(v) / len(v), 9)) for y, v in years.items())
    lo = date(reference.year - 5, reference.month, reference.day)
    inside = {k for k, m in films.items() if m["status_filme"] == "Lançado" and m["data_lancamento"] and lo <= m["data_lancamento"] <= reference}
    acted = Counter(b["sk_person_id"] for b in r["bridge_movie_person"] if b["sk_movie_id"] in inside and who[b["sk_person_id"]]["tipo_pessoa"] == "Ator")
    out["q07"] = sorted((who[p]["nome_pessoa"], n) for p, n in acted.items() if n == max(acted.values()))
    directed = defaultdict(list)
    for b in r["bridge_movie_person"]:
        if who[b["sk_person_id"]]["tipo_pessoa"] == "Diretor":
            directed[b["sk_person_id"]].append((facts.get(b["sk_movie_id"]) or {}).get("nota_imdb") or 0)
    means = [(p, sum(x for x in v if x > 0) / sum(x > 0 for x in v)) for p, v in directed.items() if len(v) >= 5 and any(x > 0 for x in v)]
    out["q08"] = sorted((pl, who[p]["nome_pessoa"], v) for pl, p, v in ranked(means, 10, 9))
    cast = defaultdict(lambda: ([], []))
    for b in r["bridge_movie_person"]:
        cast[b["sk_movie_id"]][who[b["sk_person_id"]]["tipo_pessoa"] == "Diretor"].append(b["sk_person_id"])
    pairs = Counter((a, d) for acts, dirs in cast.values() for a in acts for d in dirs)
    out["q09"] = sorted((who[a]["nome_pessoa"], who[d]["nome_pessoa"], n) for (a, d), n in pairs.items() if n == max(pairs.values()))
    n_by = Counter(b["sk_genre_id"] for b in r["bridge_movie_genre"])
    out["q10"] = sorted((g, n_by[k]) for k, g in genre.items())
    totals = defaultdict(list)
    for b in r["bridge_movie_company"]:
        if b["sk_movie_id"] in facts:
            totals[b["sk_company_id"]].append(facts[b["sk_movie_id"]]["lucro_brl"])
    company = {c["sk_company_id"]: c["nome_produtora"] for c in r["dim_companies"]}
    out["q11"] = sorted((company[c], float(sum(v)), len(v)) for c, v in totals.items() if sum(v) == max(map(sum, totals.values())))
    by_genre = defaultdict(list)
    for b in r["bridge_movie_genre"]:
        if b["sk_movie_id"] in margin:
            by_genre[genre[b["sk_genre_id"]]].append(margin[b["sk_movie_id"]])
    best = {g: round(sum(v) / len(v), 12) for g, v in by_genre.items()}
    out["q12"] = sorted((g, v, len(by_genre[g])) for g, v in best.items() if v == max(best.values()))
    out["q13"] = top([(x["sk_movie_id"], x["qtd_avaliacoes_usuarios"]) for x in r["dim_reviews"] if x["qtd_avaliacoes_usuarios"] > 0], 10, 0)
    out["q14"] = top([(x["sk_movie_id"], abs(x["nota_media_usuarios"] - facts[x["sk_movie_id"]]["nota_imdb"])) for x in r["dim_reviews"] if x["nota_media_usuarios"] is not None and ((facts.get(x["sk_movie_id"]) or {}).get("nota_imdb") or 0) > 0], 10, 9)
    return out
