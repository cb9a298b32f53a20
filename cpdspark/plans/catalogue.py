"""Ready-made models for apartment and article tables."""

from __future__ import annotations

from cpdspark.plans.spec import (
    ModelSpec,
    band,
    bernoulli,
    cat,
    emb_cat,
    emb_num,
    freq,
    hard,
    num,
    uniform,
    uniform_cont,
)


def rent_plain() -> ModelSpec:
    return ModelSpec(
        (
            uniform("state"),
            cat("city", "state"),
            cat("zip", "state", "city"),
            num("living_space", "state", "city"),
            cat("construct_year", "city", band("living_space", 10)),
            num("rent", band("living_space", 10), "state", "city", "construct_year"),
        ),
        "rent_plain",
    )


def rent_embedding() -> ModelSpec:
    return ModelSpec(
        (
            uniform("state"),
            emb_cat("city", "state", k=1),
            emb_cat("zip", "state", "city", k=1),
            emb_num("living_space", "state", "city", k=15),
            emb_cat("construct_year", "city", band("living_space", 30), k=15),
            emb_num("rent", band("living_space", 10), "state", "city", "construct_year", k=15),
        ),
        "rent_embedding",
    )


_RENT_ROOTS = (
    uniform("state"),
    uniform("city"),
    uniform("zip"),
    uniform_cont("living_space"),
    uniform("construct_year"),
)


def rent_plain_no_rules() -> ModelSpec:
    rent = num("rent", band("living_space", 10), "state", "city", "zip", "construct_year")
    return ModelSpec((*_RENT_ROOTS, rent), "rent_plain_no_rules")


def rent_embedding_no_rules() -> ModelSpec:
    rent = emb_num("rent", band("living_space", 10), "state", "city", "zip", "construct_year", k=15)
    return ModelSpec((*_RENT_ROOTS, rent), "rent_embedding_no_rules")


def neo_rent(embedded: bool = False, neighbours: int = 15) -> ModelSpec:
    """The rent models with state by frequency."""
    base = rent_embedding() if embedded else rent_plain()
    nodes = [freq("state"), *base.nodes[1:]]
    if embedded and neighbours != 15:
        nodes[-1] = emb_num("rent", band("living_space", 10), "state", "city", k=neighbours)
    return ModelSpec(tuple(nodes), "neo_rent_embedding" if embedded else "neo_rent_plain")


def simple_rent(form: str = "plain") -> ModelSpec:
    """``plain``: rent given city; ``embedding``: rent given zip, with neighbours; the two
    ``no_rules`` forms have uniform roots and rent given state, city and zip.
    """
    if form.startswith("no_rules"):
        where = ("state", "city", "zip")
        rent = emb_num("rent", *where, k=5) if form == "no_rules_embedding" else num("rent", *where)
        return ModelSpec((*[uniform(a) for a in where], rent), f"simple_rent_{form}")
    if form == "embedding":
        city, zip_code, rent = emb_cat("city", "state", k=1), emb_cat("zip", "city", k=1), emb_num("rent", "zip", k=5)
    else:
        city, zip_code, rent = cat("city", "state"), cat("zip", "city"), num("rent", "city")
    return ModelSpec((uniform("state"), city, zip_code, rent), f"simple_rent_{form}")


def enriched_rent(embedded: bool = False) -> ModelSpec:
    parents = (band("living_space", 10), "state", "city", band("has_parking", 0), band("has_balcony", 0), "heating_type")
    heating = ("construct_year", "city")
    if embedded:
        nodes = {
            "city": emb_cat("city", "state", k=1),
            "zip": emb_cat("zip", "state", "city", k=1),
            "heating": emb_cat("heating_type", *heating, k=15),
            "rent": emb_num("rent", *parents, k=15),
        }
    else:
        nodes = {
            "city": cat("city", "state", strict=False),
            "zip": cat("zip", "state", "city", strict=False),
            "heating": cat("heating_type", *heating, strict=False),
            "rent": num("rent", *parents, strict=False),
        }
    return ModelSpec(
        (
            freq("state"),
            nodes["city"],
            nodes["zip"],
            uniform_cont("living_space"),
            freq("construct_year"),
            nodes["heating"],
            bernoulli("has_parking"),
            bernoulli("has_balcony"),
            nodes["rent"],
        ),
        "enriched_rent_embedding" if embedded else "enriched_rent_plain",
    )


_ARTICLE_ROOTS = tuple(
    uniform(a) for a in ("catalog_id", "article_id", "unit", "keywords", "manufacturer_name", "set_id")
)


def article_plain_no_rules() -> ModelSpec:
    price = num("ek_amount", "catalog_id", "set_id", "keywords", "unit", "manufacturer_name")
    return ModelSpec((*_ARTICLE_ROOTS, price), "article_plain_no_rules")


def article_embedding_no_rules() -> ModelSpec:
    price = emb_num("ek_amount", "catalog_id", "set_id", "keywords", hard("unit"), "manufacturer_name", k=10)
    return ModelSpec((*_ARTICLE_ROOTS, price), "article_embedding_no_rules")


def article_plain() -> ModelSpec:
    return ModelSpec(
        (
            uniform("catalog_id"),
            uniform("keywords"),
            uniform("article_id"),
            cat("unit", "keywords", strict=False),
            cat("manufacturer_name", "keywords", strict=False),
            cat("set_id", "keywords", "manufacturer_name", "unit", strict=False),
            num("ek_amount", "catalog_id", "set_id", "keywords", "unit", "manufacturer_name"),
        ),
        "article_plain",
    )


def article_embedding() -> ModelSpec:
    return ModelSpec(
        (
            uniform("catalog_id"),
            uniform("keywords"),
            uniform("article_id"),
            emb_cat("unit", "keywords", k=5),
            emb_cat("manufacturer_name", "keywords", k=10),
            emb_cat("set_id", "keywords", "manufacturer_name", hard("unit"), k=10),
            emb_num("ek_amount", "catalog_id", "set_id", k=10),
        ),
        "article_embedding",
    )


CATALOGUE = {
    "rent_plain": rent_plain,
    "rent_embedding": rent_embedding,
    "rent_plain_no_rules": rent_plain_no_rules,
    "rent_embedding_no_rules": rent_embedding_no_rules,
    "neo_rent_plain": neo_rent,
    "neo_rent_embedding": lambda: neo_rent(True),
    "neo_rent_embedding_30": lambda: neo_rent(True, 30),
    "simple_rent_plain": simple_rent,
    "simple_rent_embedding": lambda: simple_rent("embedding"),
    "simple_rent_no_rules": lambda: simple_rent("no_rules"),
    "simple_rent_no_rules_embedding": lambda: simple_rent("no_rules_embedding"),
    "enriched_rent_plain": enriched_rent,
    "enriched_rent_embedding": lambda: enriched_rent(True),
    "article_plain": article_plain,
    "article_embedding": article_embedding,
    "article_plain_no_rules": article_plain_no_rules,
    "article_embedding_no_rules": article_embedding_no_rules,
}
