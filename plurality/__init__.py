"""plurality: seeded multinomial-logit scoring and share analytics for wide
categorical tables, planned entirely as Spark DataFrame expressions."""

from plurality.spec import Choice, Factor, Rule, Perspective, Prior, Ensemble, Evidence, Catalog

__all__ = ["Choice", "Factor", "Rule", "Perspective", "Prior", "Ensemble", "Evidence", "Catalog"]
