"""Public names of internal types, from recorded members of modules.

members: module, attr, kind, target, home, qualname, name. One row for each
attribute that a module lists. Of kind `module`, target is the name of the module
it leads to; of any other kind, home, qualname and name are those of the object
(null where it has none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.aliases import small
from verdigris.operators.summary import union_last_wins
from verdigris.sources.scratch import kept

#: Modules whose own members are public, the later ones taking precedence.
LISTED = {
    "keras": ["keras", "keras.models", "keras.layers", "keras.optimizers", "keras.losses", "keras.metrics", "keras.callbacks"],
    "tensorflow": ["tensorflow", "tensorflow.keras", "tensorflow.keras.layers", "tensorflow.keras.optimizers", "tensorflow.keras.losses", "tensorflow.keras.metrics", "tensorflow.keras.callbacks", "tensorflow.nn", "tensorflow.math", "tensorflow.linalg", "tensorflow.image", "tensorflow.data", "tensorflow.train"],
    "torch": ["torch", "torch.nn", "torch.nn.functional", "torch.optim", "torch.utils", "torch.utils.data", "torch.jit", "torch.autograd", "torch.linalg", "torch.fft"],
    "torchvision": ["torchvision", "torchvision.transforms", "torchvision.datasets", "torchvision.models"],
}
#: Classes that have one public name wherever they are defined, by pattern of the internal path.
CLASSES = {
    "keras": [("keras", "^keras\\..*\\.Functional$", "keras.Model"), ("keras", "^keras\\..*\\.Sequential$", "keras.Sequential"), ("keras", "^keras\\..*\\.image\\.(DirectoryIterator|ImageDataGenerator)$", "keras.preprocessing.image.$1"), ("tensorflow", "^tensorflow\\..*$", None)],
    "tensorflow": [("tensorflow.python.data.ops", "^tensorflow\\.python\\.data\\.ops\\..*Dataset$", "tensorflow.data.Dataset")],
}
RULE = "package string, precedence int, place string, prefix string, pattern string, rewrite string, by_name boolean"


def _is_public() -> Column:
    return ~F.startswith("attr", F.lit("_"))


def leading_parts(path: Column) -> Column:
    """a, a.b and a.b.c of a.b.c."""
    parts = F.split(path, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def walked(members: DataFrame, packages: DataFrame) -> DataFrame:
    """package, module, place: the modules that a depth-first walk from each package (package) visits, and where.

    A walk takes a module's attributes in code-point order, passes by those with
    a leading underscore, and goes down into a module that it has not met at
    once; the package itself does not count as met until an attribute leads to
    it, so it may stand here twice. place: the attributes on the way. In the
    order of places the modules stand in the order of their visits, which is
    what tells the last of two names: a place is the smallest of the places of
    all modules that lead here, with the attribute behind, and no other
    assignment of places has this property, whatever circles there are. So each
    round extends the places that became smaller in the last one by one
    attribute, and keeps smaller ones; after k rounds all places of up to k
    attributes stand. Rounds: the depth of the walk, and one that finds nothing.
    """
    links = kept(members.where((F.col("kind") == "module") & _is_public() & F.col("target").isNotNull()).select("module", "attr", "target").distinct(), "links")
    start = packages.where("package IS NOT NULL").select("package", F.col("package").alias("module"), F.expr("CAST(array() AS array<string>)").alias("place")).distinct()
    old = F.lit(None).cast("array<string>")
    known = start.select("package", "module", F.lit(True).alias("moved"), "place").where("false")
    front = start
    while True:
        found = front.join(links, "module").select("package", F.col("target").alias("module"), F.concat("place", F.array("attr")).alias("place"), old.alias("old"))
        both = found.unionByName(known.select("package", "module", "place", F.col("place").alias("old")))
        known = kept(both.groupBy("package", "module").agg(F.min("place").alias("place"), F.max("old").alias("old")).select("package", "module", "place", (F.col("old").isNull() | (F.col("place") < F.col("old"))).alias("moved")), "known")
        front = known.where("moved")
        if front.isEmpty():
            return start.unionByName(known.select("package", "module", "place"))


def walked_names(members: DataFrame, packages: DataFrame) -> DataFrame:
    """package, internal, public: of the objects that the modules of a walk list, the name found last for each internal path. Objects without a home or a qualified name have none."""
    own = members.where((F.col("kind") != "module") & _is_public() & F.col("home").isNotNull() & F.col("qualname").isNotNull())
    own = own.select("module", "attr", F.concat_ws(".", "home", "qualname").alias("internal"))
    found = walked(members, packages).join(own, "module").select("package", "internal", F.concat_ws(".", "module", "attr").alias("public"), F.concat("place", F.array("attr")).alias("place"))
    return found.groupBy("package", "internal").agg(F.max_by("public", "place").alias("public"))


def listed_rules(package: str, modules: list[str], by_name: bool = True) -> list[tuple]:
    """Rules (see RULE) for the public members of these modules, the later ones taking precedence; by_name: objects without a qualified name go by their name."""
    literal = lambda m: m.replace(".", "\\.")
    return [(package, k, "public", m, f"^{literal(m)}\\.[^._][^.]*$", "$0", by_name) for k, m in enumerate(modules)]


def class_rules(package: str, classes: list[tuple[str, str, str | None]], after: int) -> list[tuple]:
    """Rules for internal paths, which take precedence over `after` others."""
    return [(package, after + k, "internal", prefix, pattern, public, True) for k, (prefix, pattern, public) in enumerate(classes)]


def standard_rules() -> list[tuple]:
    """The rules of the four packages whose modules are listed one by one."""
    return [r for p, modules in LISTED.items() for r in (*listed_rules(p, modules, p != "torchvision"), *class_rules(p, CLASSES.get(p, []), len(modules)))]


def ruled_names(members: DataFrame, rules: DataFrame) -> DataFrame:
    """package, internal, public by rules (see RULE).

    A rule looks at an object's public path (module.attr) or at its internal one
    (home.qualname, or home.name where by_name holds and there is no qualified
    name), as `place` says. It holds if that path starts with the parts of
    `prefix` and matches `pattern`; the public name is the path with `rewrite`
    in the place of the match ($0 is the whole match), none at all where rewrite
    is null. Of all rules and objects that lead to one internal path of a
    package the rule of the highest precedence counts, of one rule's objects the
    last by attribute, then by module.

    Paths meet rules by equality of their leading parts, so a rule is looked at
    by paths below its prefix alone and not by every object.
    """
    objects = members.where((F.col("kind") != "module") & _is_public() & F.col("home").isNotNull())
    internal = lambda name: F.concat(F.col("home"), F.lit("."), name)
    looks = F.array(F.struct(F.lit("public").alias("place"), F.concat_ws(".", "module", "attr").alias("path")), F.struct(F.lit("internal").alias("place"), internal(F.coalesce("qualname", "name")).alias("path")))
    paths = objects.select("module", "attr", internal(F.col("qualname")).alias("strict"), internal(F.coalesce("qualname", "name")).alias("loose"), F.explode(looks).alias("x")).where("loose IS NOT NULL")
    paths = paths.select("module", "attr", "strict", "loose", F.col("x.place").alias("place"), F.col("x.path").alias("path"), F.explode(leading_parts(F.col("x.path"))).alias("prefix"))
    met = paths.join(small(rules), ["place", "prefix"]).where(F.regexp_like("path", F.col("pattern")))
    named = met.withColumn("internal", F.when(F.col("by_name"), F.col("loose")).otherwise(F.col("strict"))).where("internal IS NOT NULL")
    public = F.when(F.col("rewrite").isNotNull(), F.regexp_replace(F.col("path"), F.col("pattern"), F.col("rewrite")))
    best = named.groupBy("package", "internal").agg(F.max_by(F.struct(public.alias("public")), F.struct("precedence", "attr", "module")).alias("b"))
    return best.select("package", "internal", "b.public").where("public IS NOT NULL")


def alias_map_of(members: DataFrame, packages: DataFrame, rules: DataFrame) -> DataFrame:
    """package, internal, public of all packages: by rules for those that have some, by a walk for the others."""
    ruled = rules.select("package").distinct()
    free = packages.select("package").distinct().join(ruled, "package", "left_anti")
    chosen = rules.join(packages.select("package").distinct(), "package", "left_semi")
    return union_last_wins([walked_names(members, free), ruled_names(members, chosen)], ["package", "internal"])
