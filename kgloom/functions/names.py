"""Names in the graph: aliases, labels, relationship types, domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases that hold everywhere.
GLOBAL_ALIASES = {
    "napoleon": "napoleon bonaparte",
    "napoleon i": "napoleon bonaparte",
    "bonaparte": "napoleon bonaparte",
}

# Aliases of a domain.
DOMAIN_ALIASES = {
    "french revolution": {
        "the emperor": "napoleon bonaparte",
        "the king": "louis xvi",
        "the convention": "national convention",
    },
    "frenchrevolution": {
        "the emperor": "napoleon bonaparte",
        "the king": "louis xvi",
    },
    "ibm cloud": {
        "ibm": "international business machines",
        "the cloud": "ibm cloud",
    },
}

# Graph labels of entity types.
LABELS = {
    "PERSON": "Person",
    "ORG": "Organization",
    "ORGANIZATION": "Organization",
    "LOC": "Location",
    "LOCATION": "Location",
    "EVENT": "Event",
    "CONCEPT": "Concept",
    "PRODUCT": "Product",
    "DATE": "Date",
    "OTHER": "Other",
}

# Entity types, and those of a domain.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT", "PRODUCT", "DATE", "OTHER")
DOMAIN_ENTITY_TYPES = {
    "french revolution": ("Person", "Event", "Location", "Concept", "Date", "Organization"),
    "frenchrevolution": ("Person", "Event", "Location", "Concept", "Date", "Organization"),
    "ibm cloud": ("Product", "Technology", "Organization", "Feature", "Concept"),
    "ibmcloud": ("Product", "Technology", "Organization", "Feature", "Concept"),
    "cloud": ("Product", "Technology", "Organization", "Feature", "Concept"),
    "financial": ("Person", "Organization", "Concept", "Date", "Product", "Market"),
    "fiqa": ("Person", "Organization", "Concept", "Date", "Product", "Market"),
    "government": ("Organization", "Person", "Location", "Concept", "Date", "Policy"),
    "govt": ("Organization", "Person", "Location", "Concept", "Date", "Policy"),
}
DEFAULT_REL_TYPE, DEFAULT_STRENGTH = "RELATED_TO", 5


def clean_name(name: Column) -> Column:
    return F.trim(F.lower(name))


def _squeezed(x: Column) -> Column:
    return F.replace(F.replace(clean_name(x), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))


def canonical_name(name: Column, domain: Column | None = None) -> Column:
    """The name that an alias stands for: by the domain's rules first, then by the global ones, else the name itself.

    A domain's rules hold if its name without blanks and the rule's contain each other either way. The rules are few and
    fixed, so they are an expression, not a join.
    """
    key = clean_name(name)
    out = None
    if domain is not None:
        squeezed = _squeezed(domain)
        for rule, aliases in DOMAIN_ALIASES.items():
            rule = rule.replace(" ", "")
            holds = F.coalesce(squeezed, F.lit("")) != ""
            holds &= F.contains(squeezed, F.lit(rule)) | F.contains(F.lit(rule), squeezed)
            for alias, to in aliases.items():
                out = (F.when if out is None else out.when)(holds & (key == alias), F.lit(to))
    for alias, to in GLOBAL_ALIASES.items():
        out = (F.when if out is None else out.when)(key == alias, F.lit(to))
    return out.otherwise(name)


def label_of(entity_type: Column) -> Column:
    """Graph label of an entity type; unknown types get a capital first letter."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    other = F.concat(F.upper(F.substring(entity_type, 1, 1)), F.lower(F.substring(entity_type, 2, 1 << 20)))
    return F.coalesce(F.try_element_at(table, F.trim(F.upper(entity_type))), other)


def rel_type(raw: Column) -> Column:
    """A relationship type with every other character replaced by _, at most 100 characters, upper case."""
    plain = F.regexp_replace(raw, "[^a-zA-Z0-9_]", "_")
    plain = F.when(F.rlike(plain, F.lit("^[0-9]")), F.concat(F.lit("REL_"), plain)).otherwise(plain)
    return F.when(F.coalesce(plain, F.lit("")).isin("", "_"), DEFAULT_REL_TYPE).otherwise(F.upper(F.substring(plain, 1, 100)))


def rel_type_of_keywords(raw: Column) -> Column:
    """A relationship type with every run of other characters replaced by one _, at most 50 characters, upper case."""
    plain = F.substring(F.btrim(F.upper(F.regexp_replace(raw, "[^a-zA-Z0-9]+", "_")), F.lit("_")), 1, 50)
    return F.when(F.coalesce(plain, F.lit("")) == "", DEFAULT_REL_TYPE).otherwise(plain)


def entity_types_of(domain: Column) -> Column:
    """Entity types of a domain: by its exact name without blanks, else by containment either way, else the default ones."""
    squeezed = _squeezed(domain)
    default = F.array(*map(F.lit, ENTITY_TYPES))
    out = F.when(F.coalesce(domain, F.lit("")) == "", default)
    for name, types in DOMAIN_ENTITY_TYPES.items():
        out = out.when(squeezed == name, F.array(*map(F.lit, types)))
    for name, types in DOMAIN_ENTITY_TYPES.items():
        out = out.when(F.contains(squeezed, F.lit(name)) | F.contains(F.lit(name), squeezed), F.array(*map(F.lit, types)))
    return out.otherwise(default)


def domain_of_path(path: Column) -> Column:
    """Stem of a file's name in lower case, without .jsonl however often."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)(\.jsonl)+$", ""))


def domain_of_line(title: Column, doc_id: Column) -> Column:
    """The title, else the id up to its first hyphen, else unknown."""
    head = F.split(F.coalesce(doc_id, F.lit("unknown")), "-")[0]
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(head)
