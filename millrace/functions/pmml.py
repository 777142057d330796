"""PMML expressions, field treatment and two model kinds, read from XML and compiled to column expressions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import over
from millrace.plans.naming import free

Fields = Callable[[str], Column]


def _tag(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _children(node: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in node if _tag(c) in names]


def _mean(*x: Column) -> Column:
    return sum(x[1:], x[0]) / len(x)


#: The functions that expressions may call.
BUILT_IN: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: over(a, b),
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0], "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "sum": lambda *x: sum(x[1:], x[0]), "avg": _mean, "log10": F.log10, "ln": F.log, "sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "pow": F.pow,
    "threshold": lambda a, b: F.when(a > b, 1.0).when(a.isNotNull() & b.isNotNull(), 0.0), "floor": F.floor, "ceil": F.ceil, "round": lambda a: F.floor(a + 0.5),
    "uppercase": F.upper, "substring": lambda s, start, length: F.substring(s, start.cast("int"), length.cast("int")), "trimBlanks": F.trim,
}


class Functions:
    """The document's own functions by name, besides the built-in ones."""

    def __init__(self, dictionary: ET.Element | None = None):
        self.defined = {n.get("name"): n for n in _children(dictionary, "DefineFunction")} if dictionary is not None else {}

    def call(self, name: str, arguments: list[Column]) -> Column:
        if name not in self.defined:
            if name not in BUILT_IN:
                raise ValueError(f"no function is named {name}")
            return BUILT_IN[name](*arguments)
        node = self.defined[name]
        names = [p.get("name") for p in _children(node, "ParameterField")]
        if len(names) != len(arguments):
            raise ValueError(f"{name} takes {len(names)} arguments")
        return expression(next(c for c in node if _tag(c) != "ParameterField"), dict(zip(names, arguments)).__getitem__, self)


def _interval(x: Column, node: ET.Element) -> Column:
    """Whether a value lies in an ``Interval``: an open margin does not belong to it."""
    closure, inside = node.get("closure"), x.isNotNull()
    if (low := node.get("leftMargin")) is not None:
        inside = inside & ((x >= float(low)) if closure.startswith("closed") else (x > float(low)))
    if (high := node.get("rightMargin")) is not None:
        inside = inside & ((x <= float(high)) if closure.endswith("Closed") else (x < float(high)))
    return inside


def _piecewise(x: Column, points: list[tuple[float, float]], outliers: str) -> Column:
    """Straight lines between points of rising first value, and on beyond the ends, unless outliers are cut or missing."""
    line = lambda a, b: a[1] + (x - a[0]) / (b[0] - a[0]) * (b[1] - a[1])
    (first, last), inner = (points[0], points[-1]), list(zip(points, points[1:]))
    low, high = line(*inner[0]), line(*inner[-1])
    if outliers == "asExtremeValues":
        low, high = F.lit(first[1]), F.lit(last[1])
    elif outliers == "asMissingValues":
        low = high = F.lit(None).cast("double")
    value = F.when(x < first[0], low).when(x > last[0], high)
    for a, b in inner:
        value = value.when(x <= b[0], line(a, b))
    return value


def expression(node: ET.Element, fields: Fields, functions: Functions | None = None) -> Column:
    """One expression element as a column; a missing field gives what ``mapMissingTo`` says, or a missing cell."""
    functions, kind, other = functions or Functions(), _tag(node), node.get("mapMissingTo")
    if kind == "Constant":
        text = node.text or ""
        return F.lit(text if node.get("dataType") == "string" else float(text))
    if kind == "FieldRef":
        return fields(node.get("field")) if other is None else F.coalesce(fields(node.get("field")), F.lit(other))
    if kind == "Apply":
        return functions.call(node.get("function"), [expression(c, fields, functions) for c in node if _tag(c) != "Extension"])
    x = fields(node.get("field"))
    if kind == "NormContinuous":
        points = [(float(p.get("orig")), float(p.get("norm"))) for p in _children(node, "LinearNorm")]
        value = _piecewise(x.cast("double"), points, node.get("outliers", "asIs"))
        return value if other is None else F.coalesce(value, F.lit(float(other)))
    if kind == "NormDiscrete":
        value = F.when(x.isNotNull(), F.when(x.cast("string") == node.get("value"), 1.0).otherwise(0.0))
        return value if other is None else F.coalesce(value, F.lit(float(other)))
    if kind == "Discretize":
        value, number = F.when(x.isNull(), F.lit(other)), x.cast("double")
        for b in _children(node, "DiscretizeBin"):
            value = value.when(_interval(number, _children(b, "Interval")[0]), F.lit(b.get("binValue")))
        return value.otherwise(F.lit(node.get("defaultValue")))
    raise ValueError(f"no expression is named {kind}")


def treated(x: Column, field: ET.Element, values: list[str] | None = None) -> Column:
    """A mining field: outliers cut to the bounds or missing, values that are not listed missing, then missing ones replaced."""
    low, high = field.get("lowValue"), field.get("highValue")
    if low is not None and high is not None and field.get("outliers", "asIs") != "asIs":
        extreme = field.get("outliers") == "asExtremeValues"
        x = F.when(x < float(low), float(low) if extreme else None).when(x > float(high), float(high) if extreme else None).otherwise(x)
    if values and field.get("invalidValueTreatment", "returnInvalid") == "asMissing":
        x = F.when(x.isin(values), x)
    other = field.get("missingValueReplacement")
    if other is None:
        return x
    return F.coalesce(x, F.lit(other if values else float(other)))


class Document:
    """Fields, derived fields and functions of a document, bound to a table's columns.

    ``mapping`` gives the column of a field that is called otherwise in the table.
    """

    def __init__(self, text: str, mapping: dict[str, str] | None = None):
        self.root, self.mapping = ET.fromstring(text), mapping or {}
        found = lambda name: next(iter(self.root.iter(name)), None) if "}" not in self.root.tag else next((e for e in self.root.iter() if _tag(e) == name), None)
        self.found = found
        self.functions = Functions(found("TransformationDictionary"))
        self.mining = {f.get("name"): f for f in (found("MiningSchema") if found("MiningSchema") is not None else []) if _tag(f) == "MiningField"}
        self.values = {f.get("name"): [v.get("value") for v in _children(f, "Value")] for f in (found("DataDictionary") if found("DataDictionary") is not None else []) if _tag(f) == "DataField"}
        self.derived = {d.get("name"): d for d in self.root.iter() if _tag(d) == "DerivedField" and d.get("name")}

    def missing_columns(self, df: DataFrame) -> list[str]:
        """Active fields without a column."""
        return [n for n, f in self.mining.items() if f.get("usageType", "active") == "active" and self.mapping.get(n, n) not in df.columns]

    def field(self, name: str) -> Column:
        if name in self.derived:
            return expression(next(c for c in self.derived[name] if _tag(c) != "Extension"), self.field, self.functions)
        x = F.col(f"`{self.mapping.get(name, name)}`")
        return treated(x, self.mining[name], self.values.get(name)) if name in self.mining else x

    def columns(self, df: DataFrame) -> DataFrame:
        """``df`` with the document's derived fields."""
        return df.withColumns({n: self.field(n) for n in self.derived})

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, and ``distribution`` for classes."""
        if missing := self.missing_columns(df):
            raise ValueError(f"no column for {', '.join(missing)}")
        if (model := self.found("RegressionModel")) is not None:
            return _regression(self, model, df)
        if (model := self.found("NeuralNetwork")) is not None:
            return _network(self, model, df)
        raise ValueError("the document has no model that can be applied")


def _classes(df: DataFrame, scores: list[tuple[str, Column]], normal: str) -> DataFrame:
    raw, names = free(df, "_scores")[0], [n for n, _ in scores]
    held = df.withColumn(raw, F.array(*[s for _, s in scores]))
    x = F.col(raw)
    if normal == "softmax":
        powers = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        shown = F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))
    elif normal in ("simplemax", "none"):
        shown = F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)) if normal == "simplemax" else x
    else:
        one = {"logit": lambda v: 1 / (1 + F.exp(-v)), "exp": F.exp, "cloglog": lambda v: 1 - F.exp(-F.exp(v)), "loglog": lambda v: F.exp(-F.exp(-v))}[normal]
        shown = F.transform(x, one)
        if len(names) == 2:
            shown = F.array(F.get(shown, F.lit(0)), 1 - F.get(shown, F.lit(0)))
    held = held.withColumn("distribution", shown).drop(raw)
    at = F.array_position("distribution", F.array_max("distribution"))
    return held.withColumn("prediction", F.element_at(F.array(*[F.lit(n) for n in names]), at.cast("int")))


def _regression(doc: Document, model: ET.Element, df: DataFrame) -> DataFrame:
    def score(table: ET.Element) -> Column:
        s = F.lit(float(table.get("intercept", "0")))
        for p in table:
            if _tag(p) == "NumericPredictor":
                s = s + F.pow(doc.field(p.get("name")).cast("double"), F.lit(float(p.get("exponent", "1")))) * float(p.get("coefficient"))
            elif _tag(p) == "CategoricalPredictor":
                s = s + F.when(doc.field(p.get("name")).cast("string") == p.get("value"), float(p.get("coefficient"))).otherwise(0.0)
            elif _tag(p) == "PredictorTerm":
                product = F.lit(float(p.get("coefficient")))
                for r in _children(p, "FieldRef"):
                    product = product * doc.field(r.get("field")).cast("double")
                s = s + product
        return s

    tables, normal = _children(model, "RegressionTable"), model.get("normalizationMethod", "none")
    if model.get("functionName") == "classification":
        return _classes(df, [(t.get("targetCategory"), score(t)) for t in tables], normal)
    value = score(tables[0])
    after = {"none": value, "exp": F.exp(value), "logit": 1 / (1 + F.exp(-value)), "softmax": 1 / (1 + F.exp(-value))}[normal]
    return df.withColumn("prediction", after)


def _network(doc: Document, model: ET.Element, df: DataFrame) -> DataFrame:
    """Neurons layer by layer, each layer in columns of its own, so that expressions stay short."""
    act = {
        "logistic": lambda z: 1 / (1 + F.exp(-z)), "tanh": F.tanh, "identity": lambda z: z, "exponential": F.exp, "reciprocal": lambda z: over(F.lit(1.0), z),
        "square": lambda z: z * z, "Gauss": lambda z: F.exp(-z * z), "sine": F.sin, "cosine": F.cos, "Elliott": lambda z: z / (1 + F.abs(z)), "arctan": lambda z: 2 * F.atan(z) / 3.141592653589793,
        "threshold": lambda z: F.when(z > float(model.get("threshold", "0")), 1.0).otherwise(0.0),
    }
    held, at = df, {}
    inputs = [(n.get("id"), next(c for c in _children(n, "DerivedField")[0] if _tag(c) != "Extension")) for n in _children(_children(model, "NeuralInputs")[0], "NeuralInput")]
    names = free(df, *[f"_n{i}" for i, _ in inputs])
    held = held.withColumns({name: expression(e, doc.field, doc.functions).cast("double") for name, (_, e) in zip(names, inputs)})
    at.update({i: name for (i, _), name in zip(inputs, names)})
    for layer in _children(model, "NeuralLayer"):
        f = act[layer.get("activationFunction", model.get("activationFunction"))]
        neurons = _children(layer, "Neuron")
        made = free(held, *[f"_n{n.get('id')}" for n in neurons])
        sums = [sum((F.col(at[c.get("from")]) * float(c.get("weight")) for c in _children(n, "Con")), F.lit(float(n.get("bias", "0")))) for n in neurons]
        held = held.withColumns({name: f(s) for name, s in zip(made, sums)})
        at.update({n.get("id"): name for n, name in zip(neurons, made)})
        if (layer.get("normalizationMethod") or (model.get("normalizationMethod") if layer is _children(model, "NeuralLayer")[-1] else None)) == "softmax":
            powers = [F.exp(F.col(n)) for n in made]
            total = sum(powers[1:], powers[0])
            held = held.withColumns({n: p / total for n, p in zip(made, powers)})
    outputs = []
    for o in _children(_children(model, "NeuralOutputs")[0], "NeuralOutput"):
        e = next(c for c in _children(o, "DerivedField")[0] if _tag(c) != "Extension")
        outputs.append((e, F.col(at[o.get("outputNeuron")])))
    if model.get("functionName") == "classification":
        found = _classes(held, [(e.get("value"), x) for e, x in outputs], "none")
        return found.select(*df.columns, "prediction", "distribution")
    e, x = outputs[0]
    if _tag(e) == "NormContinuous":  # the way back
        points = [(float(p.get("norm")), float(p.get("orig"))) for p in _children(e, "LinearNorm")]
        x = _piecewise(x, points, "asIs")
    return held.select(*df.columns, x.alias("prediction"))
