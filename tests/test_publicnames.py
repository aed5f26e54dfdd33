"""Public names by walks and rules against plain Python."""

import random

from verdigris.operators import aliases, publicnames

MEMBERS = "module string, attr string, kind string, target string, home string, qualname string, name string"


def plain_walk(members, package):
    """internal -> public as a recursive walk over modules gives it, and the (module, place) it visits."""
    out, met, visits = {}, set(), []
    listed = {}
    for module, attr, kind, target, home, qualname, _ in members:
        listed.setdefault(module, []).append((attr, kind, target, home, qualname))

    def go(module, place):
        visits.append((module, tuple(place)))
        for attr, kind, target, home, qualname in sorted(listed.get(module, []), key=lambda m: m[0]):
            if attr.startswith("_"):
                continue
            if kind == "module":
                if target not in met:
                    met.add(target)
                    go(target, [*place, attr])
            elif home is not None and qualname is not None:
                out[f"{home}.{qualname}"] = f"{module}.{attr}"

    go(package, [])
    return out, visits


def graph(r, n, links):
    rows = {}
    for _ in range(links):
        a, attr, b = f"m{r.randrange(n)}", r.choice(["_", "", "", "é", "Z"]) + f"a{r.randrange(8)}", f"m{r.randrange(n)}"
        rows[a, attr] = (a, attr, "module", b, None, None, None)
    for k in range(3 * n):
        a, attr = f"m{r.randrange(n)}", r.choice("_xyzA") + str(r.randrange(9))
        rows[a, attr] = (a, attr, "type", None, r.choice(["h", None, "g"]), r.choice([f"q{k % 5}", None, f"q{k % 7}"]), "n")
    return list(rows.values())


def test_walks_of_random_graphs(spark):
    """Circles, diamonds, modules that lead to themselves, and a package that is met again on the way."""
    r = random.Random(4)
    for n, links in ((3, 6), (8, 12), (12, 40), (25, 60)):
        rows = graph(r, n, links)
        packages = [f"m{k}" for k in range(min(n, 5))] + ["absent"]
        members = spark.createDataFrame(rows, MEMBERS)
        given = spark.createDataFrame([(p,) for p in [*packages, packages[0], None]], "package string")
        found = {}
        for x in publicnames.walked(members, given).collect():
            found.setdefault(x.package, []).append((x.module, tuple(x.place)))
        names = {(x.package, x.internal): x.public for x in publicnames.walked_names(members, given).collect()}
        for p in packages:
            want, visits = plain_walk(rows, p)
            assert sorted(found[p], key=lambda v: v[1]) == visits
            assert {i: v for (q, i), v in names.items() if q == p} == want


def test_rules_and_the_whole_map(spark):
    thing = lambda module, attr, home, qualname, name="n": (module, attr, "type", None, home, qualname, name)
    rows = [
        thing("torch", "Tensor", "torch", "Tensor"), thing("torch.nn", "Linear", "torch.nn.modules", "Linear"), thing("torch.jit", "Linear2", "torch.nn.modules", "Linear"), thing("torch", "Linear3", "torch.nn.modules", "Linear"),
        thing("torch.nn.modules", "Deep", "torch.nn.modules", "Deep"), thing("torch.nn", "_hidden", "torch.nn", "hidden"), thing("torch.nn", "relu", "torch._C", None, "relu"),
        thing("torchvision", "nameless", "torchvision", None, "nameless"), thing("torchvision.models", "a", "torchvision.x", "R"), thing("torchvision.models", "b", "torchvision.x", "R"),
        thing("keras", "Model", "keras.src.models.functional", "Functional"), thing("keras.models", "Other", "keras.src.models.functional", "Functional"), thing("keras.layers", "T", "tensorflow.python", "T"),
        thing("keras.anything", "it", "keras.src.legacy.image", "DirectoryIterator"), thing("tensorflow.private", "p", "tensorflow.python.data.ops.prefetch_op", "_PrefetchDataset"),
        ("free", "sub", "module", "free.sub", None, None, None), thing("free.sub", "C", "free._c", "C"), thing("free", "C", "free._c", "C"), thing("free", "tail", "free._t", "tail"), thing("nobody", "x", "nobody", "x"),
    ]
    rules = spark.createDataFrame(publicnames.standard_rules(), publicnames.RULE)
    members = spark.createDataFrame(rows, MEMBERS)
    packages = spark.createDataFrame([(p,) for p in ("torch", "torchvision", "keras", "tensorflow", "free")], "package string")
    got = {(r.package, r.internal): r.public for r in publicnames.alias_map_of(members, packages, rules).collect()}
    assert got == {
        ("torch", "torch.Tensor"): "torch.Tensor", ("torch", "torch.nn.modules.Linear"): "torch.jit.Linear2", ("torch", "torch._C.relu"): "torch.nn.relu",
        ("torchvision", "torchvision.x.R"): "torchvision.models.b", ("keras", "keras.src.models.functional.Functional"): "keras.Model", ("keras", "keras.src.legacy.image.DirectoryIterator"): "keras.preprocessing.image.DirectoryIterator",
        ("tensorflow", "tensorflow.python.data.ops.prefetch_op._PrefetchDataset"): "tensorflow.data.Dataset", ("free", "free._c.C"): "free.sub.C", ("free", "free._t.tail"): "free.tail",
    }
    assert aliases.cleaned_map(publicnames.alias_map_of(members, packages, rules)).count() == len(got)
    # without keras among the packages its rules say nothing
    assert {r.package for r in publicnames.alias_map_of(members, packages.where("package <> 'keras'"), rules).collect()} == {"torch", "torchvision", "tensorflow", "free"}


def test_rules_by_precedence(spark):
    rows = [("p.a", "X", "type", None, "p.in", "X", None), ("p.b", "Y", "type", None, "p.in", "X", None), ("p.a", "Z", "type", None, "p.in", "Z", None)]
    rule = lambda precedence, place, prefix, pattern, rewrite: ("p", precedence, place, prefix, pattern, rewrite, True)
    names = lambda *rules: {r.internal: r.public for r in publicnames.ruled_names(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame(list(rules), publicnames.RULE)).collect()}
    a, b = rule(1, "public", "p.a", "^p\\.a\\.(.*)$", "A.$1"), rule(2, "public", "p.b", "^p\\.b\\.(.*)$", "B.$1")
    assert names(a, b) == {"p.in.X": "B.Y", "p.in.Z": "A.Z"}
    assert names(rule(3, *a[2:6]), b) == {"p.in.X": "A.X", "p.in.Z": "A.Z"}
    assert names(a, b, rule(9, "internal", "p", "X$", None)) == {"p.in.Z": "A.Z"} and names(a, b, rule(0, "internal", "p", "X$", None)) == names(a, b)
    assert names(rule(1, "public", "p.aa", ".*", "no"), rule(1, "public", "a", ".*", "no")) == {}
