"""Reference queries against plain-Python answers, on random and on hand-made catalogues."""

from datetime import date

import pytest

from tarnspark.operators import cases as C
from tests.catalogue import answers, base, random_catalogue

REF = date(2026, 10, 1)
#: case -> how a row of the result reads in the plain answers
VIEW = {
    **{q: (lambda r, v=v: (r["posicao"], r["id_filme"], float(r[v]))) for q, v in (("q01", "receita_brl"), ("q03", "margem_lucro"), ("q04", "popularidade"), ("q05", "divergencia"), ("q13", "qtd_avaliacoes_usuarios"), ("q14", "divergencia"))},
    "q02": lambda r: (r["genero"], r["filmes"], r["lucro_medio_brl"]), "q06": lambda r: (r["ano_lancamento"] or 0, r["filmes_com_nota"], r["nota_media_imdb"]), "q07": lambda r: (r["ator"], r["filmes"]), "q08": lambda r: (r["posicao"], r["diretor"], r["media_imdb"]),
    "q09": lambda r: (r["ator"], r["diretor"], r["filmes_juntos"]), "q09_pruned": lambda r: (r["ator"], r["diretor"], r["filmes_juntos"]), "q10": lambda r: (r["genero"], r["filmes"]), "q11": lambda r: (r["produtora"], r["lucro_total_brl"], r["filmes"]), "q12": lambda r: (r["genero"], r["margem_media"], r["filmes"]),
}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_catalogues(spark, seed):
    rows = random_catalogue(seed)
    star, want = rows.star(spark, shuffle=seed), answers(rows, REF)
    for name, view in VIEW.items():
        got = sorted(view(r.asDict()) for r in C.CASES[name].frame(star, REF).collect())
        expected = want[name.removesuffix("_pruned")]
        assert len(got) == len(expected), name
        near = 0.0101 if name == "q02" else 1e-8  # a mean that ends on half a cent may be rounded either way
        for g, w in zip(got, expected):
            assert all(a == (b if isinstance(a, str) else pytest.approx(b, abs=near)) for a, b in zip(g, w)), (name, g, w)


def test_ties_at_the_cutoff_and_order(spark):
    r = base()
    for i in range(9):
        r.film(i, receita_brl=1000 - i)
    r.film(10, "Tie", receita_brl=500)
    r.film(20, "Tie", receita_brl=500.0)
    r.film(30, receita_brl=1)
    star = r.star(spark)
    got = C.run_case(star, C.CASES["q01"], REF)
    assert len(got.rows) == 11 and [x["id_filme"] for x in got.records()][-2:] == ["10", "20"]
    assert len(C.run_case(star, C.variant("q01", limit=3), REF).rows) == 3


def test_free_cases_and_runner(spark):
    r = base()
    r["dim_people"] += [{"sk_person_id": "gg", "nome_pessoa": "Greta Gerwig", "tipo_pessoa": "Diretor"}]
    r.film(1, "Silence", year=2019, day=date(2024, 1, 1), genres=["g03"], receita_usd=10, people=["gg", "p0"])
    r.film(2, "Silence", year=2016, day=date(2020, 1, 1), genres=["g11"], receita_usd=5, people=["p0"])
    star = r.star(spark)
    assert C.run_case(star, C.CASES["f1"], REF).rows == (("p0", "Person 0", 1),)
    assert [x[0] for x in C.run_case(star, C.CASES["f2"], REF).rows] == ["1"]
    assert C.run_case(star, C.CASES["f3"], REF).rows == ((10.0,),)
    assert C.run_case(star, C.CASES["f4"], REF).rows == ((1,),)
    assert [x[0] for x in C.run_case(star, C.CASES["f5"], REF).rows] == ["2", "1"]
    with pytest.raises(C.CaseError):
        C.run_case(star, C.variant("f5", max_rows=1), REF)
    with pytest.raises(C.CaseError):
        C.run_case(star, C.variant("f5", key=("titulo",)), REF)
    with pytest.raises(ValueError):
        C.variant("q01", limit=0)


def test_window_edges(spark):
    from tarnspark.functions.windows import rolling_window

    assert rolling_window(date(2024, 2, 29), 5) == (date(2019, 2, 28), date(2024, 2, 29))
    for bad in (0, True, 2024):
        with pytest.raises(ValueError):
            rolling_window(date(2024, 1, 1), bad)
