"""Queries of the expression languages, special functions, estimators, text functions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import special
from millrace.functions.pmml import Document
from millrace.functions.predicates import compile_attributes, compile_math, compile_predicate
from millrace.operators import columns as C
from millrace.operators import estimators as E
from millrace.operators import evaluation, stats, text
from millrace.plans.catalog import _register, query, table
from millrace.plans.mining_queries import _rounded

_register(
    "arithmetic", "part",
    lambda t: _rounded(t.select("p_partkey", *[compile_attributes(e, t.select("p_partkey", "p_size", "p_retailprice").columns).alias(n) for n, e in (
        ("powers", "((a2+1)*(a2))^2 / a3"), ("root", "sqrt(a2+a3)^2 - a2"), ("mixed", "abs(-a2) + exp(a2/100) * floor(a3/7) - ceil(a3/9) + rint(a3/4)"), ("waves", "sin(a2) + cos(a3) * tan(a2/50) - log(a3)"), ("left", "2^a2^0.5 - a3/a2*2"))]), "powers", "root", "mixed", "waves", "left", places=5),
    "SELECT p_partkey, round(((p_size + 1) * p_size) ** 2 / p_retailprice, 5) AS powers, round(p_retailprice, 5) AS root, round(p_size + exp(p_size / 100) * floor(p_retailprice / 7) - ceil(p_retailprice / 9) + round_even(p_retailprice / 4, 0), 5) AS mixed, "
    "round(sin(p_size) + cos(p_retailprice) * tan(p_size / 50) - ln(p_retailprice), 5) AS waves, round((2 ** p_size) ** 0.5 - p_retailprice / p_size * 2, 5) AS \"left\" FROM part",
)
_CASES = [
    ("lt", "ATT2 < 10", "p_size < 10"), ("le", "ATT2 <= 10", "p_size <= 10"), ("gt", "ATT2 > 10", "p_size > 10"), ("ge", "ATT2 >= 10", "p_size >= 10"), ("eq", "ATT2 = 10", "p_size = 10"),
    ("missing", "ismissing(ATT2) or not ismissing(ATT3)", "true"), ("mixed", "ATT2 > 40 or ATT2 < 20 and not (abs(ATT3 - 1000) <= 50)", "(p_size > 40 OR p_size < 20) AND NOT abs(p_retailprice - 1000) <= 50"),
    ("functions", "pow(sqrt(ATT2), 2) + ceil(ATT3) - floor(ATT3) >= rint(ATT3 / 40) - log(exp(1))", "p_size + ceil(p_retailprice) - floor(p_retailprice) >= round_even(p_retailprice / 40, 0) - 1"),
    ("waves", "sin(ATT2) * cos(ATT2) < tan(ATT2) / 9", "sin(p_size) * cos(p_size) < tan(p_size) / 9"), ("named", "CLASS is 'x'", "p_brand = 'x'"), ("over", "1 / (ATT2 - 10) > 0", "p_size >= 10"),
]
_register(
    "predicates", "part", lambda t: t.select("p_partkey", "p_size", "p_retailprice", "p_brand").select("p_partkey", *[compile_predicate(p, ["p_partkey", "p_size", "p_retailprice", "p_brand"], "p_brand").alias(n) for n, p, _ in _CASES]),
    "SELECT p_partkey, " + ", ".join(f"{s} AS {n}" for n, _, s in _CASES) + " FROM part",
)
_register(
    "conditional_arithmetic", "part", lambda t: _rounded(t.select("p_partkey", compile_math("ifelse(SIZE > 25 | PRICE < 950, PRICE / SIZE, ifelse(SIZE = 7, -1, SIZE ^ 2))", {"SIZE": F.col("p_size").cast("double"), "PRICE": F.col("p_retailprice")}).alias("v")), "v"),
    "SELECT p_partkey, round(CASE WHEN p_size > 25 OR p_retailprice < 950 THEN p_retailprice / p_size WHEN p_size = 7 THEN -1 ELSE p_size ** 2 END, 6) AS v FROM part",
)

_FUNCTIONS = {
    "addition": ("+", ["s", "r"], "s + r"), "subtraction": ("-", ["s", "r"], "s - r"), "multiplication": ("*", ["s", "r"], "s * r"), "division": ("/", ["r", "s"], "r / s"), "min": ("min", ["s", "r", "h"], "least(s, r, 100)"),
    "max": ("max", ["s", "r", "h"], "greatest(s, r, 100)"), "sum": ("sum", ["s", "r", "h"], "s + r + 100"), "avg": ("avg", ["s", "r", "h"], "(s + r + 100) / 3"), "log10": ("log10", ["r"], "log10(r)"), "ln": ("ln", ["r"], "ln(r)"),
    "sqrt": ("sqrt", ["s"], "sqrt(s)"), "abs": ("abs", ["n"], "s"), "exp": ("exp", ["h2"], "exp(2)"), "pow": ("pow", ["s", "h2"], "s ** 2"), "threshold": ("threshold", ["s", "h25"], "CASE WHEN s > 25 THEN 1 ELSE 0 END"),
    "floor": ("floor", ["r"], "floor(r)"), "ceil": ("ceil", ["r"], "ceil(r)"), "round": ("round", ["r"], "floor(r + 0.5)"),
}
_ARGUMENTS = {"s": '<FieldRef field="size"/>', "r": '<FieldRef field="p_retailprice"/>', "h": "<Constant>100</Constant>", "h2": "<Constant>2</Constant>", "h25": "<Constant>25</Constant>", "n": '<Apply function="-"><Constant>0</Constant><FieldRef field="size"/></Apply>'}
_DOCUMENT = (
    "<PMML><DataDictionary><DataField name='size' optype='continuous'/></DataDictionary><TransformationDictionary><DefineFunction name='twice'><ParameterField name='x'/><Apply function='*'><Constant>2</Constant><FieldRef field='x'/></Apply></DefineFunction>"
    + "".join(f"<DerivedField name='d_{n}'><Apply function='{f}'>{''.join(_ARGUMENTS[a] for a in args)}</Apply></DerivedField>" for n, (f, args, _) in _FUNCTIONS.items())
    + "<DerivedField name='d_uppercase'><Apply function='uppercase'><FieldRef field='p_name'/></Apply></DerivedField><DerivedField name='d_trimblanks'><Apply function='trimBlanks'><Constant dataType='string'>  a b </Constant></Apply></DerivedField>"
    "<DerivedField name='d_substring'><Apply function='substring'><FieldRef field='p_name'/><Constant>2</Constant><Constant>4</Constant></Apply></DerivedField><DerivedField name='d_twice'><Apply function='twice'><FieldRef field='size'/></Apply></DerivedField>"
    "<DerivedField name='d_line'><NormContinuous field='size' outliers='asExtremeValues'><LinearNorm orig='10' norm='0'/><LinearNorm orig='20' norm='1'/><LinearNorm orig='40' norm='5'/></NormContinuous></DerivedField>"
    "<DerivedField name='d_is'><NormDiscrete field='p_brand' value='{brand}'/></DerivedField>"
    "<DerivedField name='d_bin'><Discretize field='size' defaultValue='rest'><DiscretizeBin binValue='low'><Interval closure='openClosed' rightMargin='10'/></DiscretizeBin><DiscretizeBin binValue='mid'><Interval closure='openOpen' leftMargin='10' rightMargin='30'/></DiscretizeBin></Discretize></DerivedField>"
    "</TransformationDictionary></PMML>"
)


@query(
    "pmml_functions",
    "WITH t AS (SELECT *, CAST(p_size AS DOUBLE) AS s, p_retailprice AS r FROM part) SELECT p_partkey, " + ", ".join(f"round(CAST({q} AS DOUBLE), 6) AS d_{n}" for n, (_, _, q) in _FUNCTIONS.items())
    + ", upper(p_name) AS d_uppercase, 'a b' AS d_trimblanks, substr(p_name, 2, 4) AS d_substring, s * 2 AS d_twice, CASE WHEN s < 10 THEN 0.0 WHEN s > 40 THEN 5.0 WHEN s <= 20 THEN (s - 10) / 10 ELSE 1 + (s - 20) / 20 * 4 END AS d_line, "
    "CAST(CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 1 ELSE 0 END AS DOUBLE) AS d_is, CASE WHEN s <= 10 THEN 'low' WHEN s < 30 THEN 'mid' ELSE 'rest' END AS d_bin FROM t",
)
def pmml_functions(spark, d):
    t = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    doc = Document(_DOCUMENT.replace("{brand}", t.agg(F.min("p_brand")).first()[0]), {"size": "p_size"})
    return _rounded(doc.columns(t).select("p_partkey", *doc.derived), *[f"d_{n}" for n in _FUNCTIONS])


_REGRESSION = (
    "<PMML><DataDictionary><DataField name='size' optype='continuous'/><DataField name='p_retailprice' optype='continuous'/></DataDictionary><RegressionModel functionName='{kind}' normalizationMethod='{norm}'>"
    "<MiningSchema><MiningField name='size' outliers='asExtremeValues' lowValue='5' highValue='45' missingValueReplacement='20'/><MiningField name='p_retailprice'/></MiningSchema>{tables}</RegressionModel></PMML>"
)
_TABLE = "<RegressionTable intercept='{a}' targetCategory='{c}'><NumericPredictor name='size' exponent='2' coefficient='{b}'/><NumericPredictor name='p_retailprice' coefficient='0.01'/><PredictorTerm coefficient='0.0001'><FieldRef field='size'/><FieldRef field='p_retailprice'/></PredictorTerm></RegressionTable>"
_S = "(0.01 * p_retailprice + 0.0001 * least(greatest(p_size, 5), 45) * p_retailprice + {a} + {b} * least(greatest(p_size, 5), 45) ** 2)"


@query("pmml_regression", f"SELECT p_partkey, round({_S.format(a=1.5, b=0.002)}, 6) AS value, CASE WHEN {_S.format(a=0, b=0.002)} >= {_S.format(a=2, b=0.001)} THEN 'u' ELSE 'v' END AS label, round(1 / (1 + exp({_S.format(a=2, b=0.001)} - {_S.format(a=0, b=0.002)})), 6) AS p FROM part")
def pmml_regression(spark, d):
    t = table(spark, d, "part")
    line = Document(_REGRESSION.format(kind="regression", norm="none", tables=_TABLE.format(a=1.5, b=0.002, c="")), {"size": "p_size"})
    both = Document(_REGRESSION.format(kind="classification", norm="softmax", tables=_TABLE.format(a=0, b=0.002, c="u") + _TABLE.format(a=2, b=0.001, c="v")), {"size": "p_size"})
    found = line.apply(t).withColumnRenamed("prediction", "value").join(both.apply(t).select("p_partkey", F.col("prediction").alias("label"), F.get("distribution", F.lit(0)).alias("p")), "p_partkey")
    return _rounded(found.select("p_partkey", "value", "label", "p"), "value", "p")


_NETWORK = (
    "<PMML><NeuralNetwork functionName='regression' activationFunction='logistic'><MiningSchema><MiningField name='p_size'/></MiningSchema><NeuralInputs>"
    "<NeuralInput id='0'><DerivedField><NormContinuous field='p_size'><LinearNorm orig='0' norm='0'/><LinearNorm orig='50' norm='1'/></NormContinuous></DerivedField></NeuralInput></NeuralInputs>"
    "<NeuralLayer><Neuron id='1' bias='0.5'><Con from='0' weight='2'/></Neuron><Neuron id='2' bias='-1'><Con from='0' weight='3'/></Neuron></NeuralLayer>"
    "<NeuralLayer activationFunction='identity'><Neuron id='3' bias='0.1'><Con from='1' weight='1.5'/><Con from='2' weight='-0.5'/></Neuron></NeuralLayer>"
    "<NeuralOutputs><NeuralOutput outputNeuron='3'><DerivedField><NormContinuous field='y'><LinearNorm orig='0' norm='0'/><LinearNorm orig='10' norm='1'/></NormContinuous></DerivedField></NeuralOutput></NeuralOutputs></NeuralNetwork></PMML>"
)
_register(
    "pmml_network", "part", lambda t: _rounded(Document(_NETWORK).apply(t).select("p_partkey", "prediction"), "prediction"),
    "SELECT p_partkey, round(10 * (0.1 + 1.5 / (1 + exp(-0.5 - 2 * p_size / 50)) - 0.5 / (1 + exp(1 - 3 * p_size / 50))), 6) AS prediction FROM part",
)

_X = "(SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part)"
_ERF = "(SELECT 2 / sqrt(pi()) * {z} / 3000 * sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((({z}) * i / 1000) ** 2))) FROM range(1001) r(i))"


def _special(t):
    x = F.col("x")
    f = lambda g, *c: special.column(g)(*c)
    rows = t.select(F.col("p_size").cast("double").alias("x")).distinct()
    return _rounded(rows.select(
        "x", f(special.ln_gamma, x).alias("ln_gamma"), (f(special.gamma, x / 10)).alias("gamma"), f(special.ln_factorial, x).alias("ln_factorial"), f(special.log2_binomial, F.lit(50.0), x).alias("log2_binomial"),
        f(lambda a: special.log2_multinomial(60, [a, 5, 4]), x).alias("log2_multinomial"), f(special.erf, x / 20).alias("erf"), f(special.erfc, x / 20).alias("erfc"), f(special.normal_probability, x / 20).alias("normal"),
        f(lambda a: special.normal_inverse(special.normal_probability(a)), x / 20).alias("back"), f(special.chi_squared_probability, x, F.lit(4.0)).alias("chi2"), f(special.f_probability, x / 10, F.lit(2.0), F.lit(7.0)).alias("f"),
        f(special.incomplete_gamma, F.lit(2.0), x / 10).alias("lower"), f(special.incomplete_gamma_complement, F.lit(3.0), x / 10).alias("upper"), f(special.incomplete_beta, F.lit(2.0), F.lit(3.0), x / 51).alias("beta"),
        f(lambda a: special.beta_fraction1(2, 3, a) * (1 - a), x / 51).alias("fraction"), f(lambda a: special.beta_fraction2(2, 3, a), x / 51).alias("fraction2"), f(special.binomial_standard_error, x / 51, F.lit(30.0)).alias("error"), f(lambda a: special.monic_polynomial(a, [2, 0, -1]), x).alias("polynomial"),
        f(special.student_two_sided, x / 10, F.lit(2.0)).alias("student"),
    ), *["ln_gamma", "gamma", "ln_factorial", "log2_binomial", "log2_multinomial", "erf", "erfc", "normal", "back", "chi2", "f", "lower", "upper", "beta", "error", "student"], places=6).withColumn("same", F.abs(F.col("fraction") - F.col("fraction2")) < 1e-9).drop("fraction", "fraction2")


_register(
    "special_functions", "part", _special,
    "SELECT x, round(lgamma(x), 6) AS ln_gamma, round(gamma(x / 10), 6) AS gamma, round(lgamma(x + 1), 6) AS ln_factorial, round((lgamma(51) - lgamma(x + 1) - lgamma(51 - x)) / ln(2), 6) AS log2_binomial, round((lgamma(61) - lgamma(x + 1) - lgamma(6) - lgamma(5)) / ln(2), 6) AS log2_multinomial, "
    f"round({_ERF.format(z='x / 20')}, 6) AS erf, round(1 - {_ERF.format(z='x / 20')}, 6) AS erfc, round(0.5 + {_ERF.format(z='x / 20 / sqrt(2)')} / 2, 6) AS normal, round(x / 20, 6) AS back, round(exp(-x / 2) * (1 + x / 2), 6) AS chi2, round((1 + 2 * x / 10 / 7) ** -3.5, 6) AS f, "
    "round(1 - exp(-x / 10) * (1 + x / 10), 6) AS lower, round(exp(-x / 10) * (1 + x / 10 + (x / 10) ** 2 / 2), 6) AS upper, round(6 * (x / 51) ** 2 * (1 - x / 51) ** 2 + 4 * (x / 51) ** 3 * (1 - x / 51) + (x / 51) ** 4, 6) AS beta, true AS same, "
    f"round(sqrt(x / 51 * (1 - x / 51) / 30), 6) AS error, x ** 3 + 2 * x ** 2 - 1 AS polynomial, round(1 - x / 10 / sqrt(2 + (x / 10) ** 2), 6) AS student FROM {_X}",
)

_P = "p_partkey, p_size, p_retailprice, p_brand"
_register("poisson", "part", lambda t: _rounded(E.poisson(t.select("p_partkey", (F.col("p_size") % 7).alias("k")), "k"), "probability"), "SELECT p_partkey, p_size % 7 AS k, round(exp(-m + (p_size % 7) * ln(m) - lgamma(p_size % 7 + 1)), 6) AS probability FROM part, (SELECT avg(p_size % 7) AS m FROM part)")
_register(
    "joint_normal", "part", lambda t: _rounded(E.conditional_normal(E.bivariate_normal(t.select("p_partkey", (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 100).alias("y")), "x", "y"), "x", "y", "given").select("p_partkey", "density", "given"), "density", "given"),
    "WITH t AS (SELECT p_partkey, p_size / 10 AS x, p_retailprice / 100 AS y FROM part), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM t) "
    "SELECT p_partkey, round(exp(-((x - mx) ** 2 * yy - 2 * (x - mx) * (y - my) * xy + (y - my) ** 2 * xx) / (xx * yy - xy * xy) / 2) / (2 * pi() * sqrt(xx * yy - xy * xy)), 6) AS density, "
    "round(exp(-((x - mx - xy / yy * (y - my)) ** 2) / (2 * (xx - xy * xy / yy))) / sqrt(2 * pi() * (xx - xy * xy / yy)), 6) AS given FROM t, m",
)
_MOMENTS = "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS x, l_returnflag AS y FROM lineitem), m AS (SELECT y, count(*) AS n, avg(x) AS a, stddev_pop(x) AS s FROM t GROUP BY 1) "
_register(
    "class_normals", "lineitem",
    lambda t: _rounded(E.discrete_given_normal(E.normal_given_discrete(t.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("x"), F.col("l_returnflag").alias("y")), "x", "y"), "y", "x").select("l_orderkey", "l_linenumber", "density", "probability"), "density", "probability"),
    _MOMENTS + ", d AS (SELECT x, sum(n * exp(-(((x - a) / s) ** 2) / 2) / s) AS w FROM (SELECT DISTINCT x FROM t), m GROUP BY 1) SELECT t.l_orderkey, t.l_linenumber, round(exp(-(((x - a) / s) ** 2) / 2) / (s * sqrt(2 * pi())), 6) AS density, round(n * exp(-(((x - a) / s) ** 2) / 2) / s / w, 6) AS probability FROM t JOIN m USING (y) JOIN d USING (x)",
)
_register("normal_moments", "lineitem", lambda t: _rounded(E.fit_normal(t, "l_quantity", "l_returnflag", "l_tax"), "n", "mean", "deviation", places=5), "SELECT l_returnflag, round(sum(l_tax), 5) AS n, round(sum(l_tax * l_quantity) / sum(l_tax), 5) AS mean, round(sqrt(sum(l_tax * l_quantity * l_quantity) / sum(l_tax) - (sum(l_tax * l_quantity) / sum(l_tax)) ** 2), 5) AS deviation FROM lineitem GROUP BY 1")
_register("kernel_estimates", "part", lambda t: _rounded(E.kernel_given_kernel(E.discrete_given_kernel(E.kernel_given_discrete(E.kernel(t.select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("z"), F.substring("p_brand", -1, 1).alias("y")), "x", 1.0), "x", "y", 1.0, "in_class"), "y", "x", 1.0, "of_class"), "x", "z", 1.0, "given"), "probability", "in_class", "of_class", "given").drop("x", "z", "y"), None)

_register("lower_words", "part", lambda t: t.select("p_partkey", F.array_join(text.of_length(text.without(text.lower_case(text.delimited(F.col("p_name"))), ["part"]), 2, 30), " ").alias("words")), "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name, '[ \\r\\n\\t.,;:''\"()?!]+'), lambda x: lower(x)), lambda x: x <> 'part' AND length(x) BETWEEN 2 AND 30), ' ') AS words FROM part")
_register("prefixes", "part", lambda t: text.with_prefix(t, "p_type", ["S", "STANDARD", "P", "EC", "ECON"]).select("p_partkey", "prefix"), "SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'STANDARD' WHEN starts_with(p_type, 'ECON') THEN 'ECON' WHEN starts_with(p_type, 'EC') THEN 'EC' WHEN starts_with(p_type, 'P') THEN 'P' ELSE 'S' END AS prefix FROM part WHERE p_type SIMILAR TO '(S|P|EC).*'")
_register("character_tokens", "nation", lambda t: t.select("n_nationkey", F.array_join(text.delimited(F.col("n_name"), "_A"), "|").alias("tokens"), F.array_join(text.character_ngrams(F.col("n_name"), 3), "|").alias("grams")), "SELECT n_nationkey, array_to_string(list_filter(regexp_split_to_array(n_name, '[_A]+'), lambda x: x <> ''), '|') AS tokens, array_to_string([substr(n_name, i, 3) FOR i IN range(1, CAST(length(n_name) - 1 AS BIGINT))], '|') AS grams FROM nation")
_register("term_vectors", "documents", lambda t: text.term_vectors(t, "doc_id", "text", ["the", "and", "de"], 2, 12), "WITH w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: lower(x)), lambda x: x NOT IN ('the', 'and', 'de') AND length(x) BETWEEN 2 AND 12)) AS word FROM documents) SELECT doc_id, word, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY 1, 2")
_register("stop_words", "documents", lambda t: text.weighted_words(t, "doc_id", "text", ["the", "la", "und"]), "WITH w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[ \\r\\n\\t.,;:''\"()?!]+'), lambda x: lower(x)), lambda x: x NOT IN ('', 'the', 'la', 'und'))) AS word FROM documents) SELECT doc_id, word, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY 1, 2")
_register("stems", "part", lambda t: t.select("p_partkey", F.array_join(text.stemmed(text.porter)(text.delimited(F.col("p_name"))), " ").alias("stems"), F.array_join(text.stemmed(text.same)(text.delimited(F.col("p_name"))), " ").alias("plain")), None)

_register("regression_scores", "lineitem", lambda t: _rounded(evaluation.regression_scores(t, "l_discount", "l_tax"), "mean_absolute", "root_mean_squared", "correlation"), "SELECT count(*) AS n, round(avg(abs(l_tax - l_discount)), 6) AS mean_absolute, round(sqrt(avg((l_tax - l_discount) ** 2)), 6) AS root_mean_squared, round(corr(l_discount, l_tax), 6) AS correlation FROM lineitem")


def _curve(t):
    return stats.threshold_curve(t.withColumn("y", F.col("l_returnflag") == "R"), "l_discount", "y")


_CURVE = "WITH g AS (SELECT l_discount AS threshold, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1), c AS (SELECT threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () - sum(p) OVER w AS fn, sum(q) OVER () - sum(q) OVER w AS tn FROM g WINDOW w AS (ORDER BY threshold DESC)) "
_register("cost_curve", "lineitem", lambda t: _rounded(evaluation.cost_curve(_curve(t)), "cost_at_0", "cost_at_1"), _CURVE + "SELECT threshold, round(fp / (fp + tn), 6) AS cost_at_0, round(fn / (fn + tp), 6) AS cost_at_1 FROM c")
_register("cost_benefit", "lineitem", lambda t: evaluation.cost_benefit(_curve(t), (0.0, 2.0, 5.0, 0.0)), _CURVE + "SELECT threshold, CAST(2 * fp + 5 * fn AS DOUBLE) AS cost FROM c")
_register("best_threshold", "lineitem", lambda t: t.sparkSession.createDataFrame([(m, evaluation.best_threshold(_curve(t), m)) for m in ("f", "accuracy", "recall")], "measure string, threshold double"),
    _CURVE + "SELECT 'f' AS measure, arg_max(threshold, (2 * tp / (2 * tp + fp + fn), threshold)) AS threshold FROM c UNION ALL SELECT 'accuracy', arg_max(threshold, ((tp + tn) / (tp + tn + fp + fn), threshold)) FROM c UNION ALL SELECT 'recall', arg_max(threshold, (tp / (tp + fn), threshold)) FROM c")
_register("area_under_curve", "lineitem", lambda t: _rounded(evaluation.area_under(t.withColumn("y", F.col("l_returnflag") == "R"), "l_discount", "y"), "area"), "WITH a AS (SELECT l_discount AS s, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_discount AS s, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT round(sum(a.n * b.n * CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / sum(a.n * b.n), 6) AS area FROM a, b")


@query("expected_cost", "WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END AS p FROM lineitem) SELECT count(*) AS n, sum(CASE WHEN a = 'R' AND p = 'A' THEN 5 WHEN a = p THEN 0 ELSE 1 END)::DOUBLE AS total_cost, round(avg(CASE WHEN a = 'R' AND p = 'A' THEN 5 WHEN a = p THEN 0 ELSE 1 END), 6) AS mean_cost FROM x")
def expected_cost(spark, d):
    costs = spark.createDataFrame([("R", "A", 5.0)], "actual string, predicted string, cost double")
    t = table(spark, d, "lineitem").withColumn("p", F.when(F.col("l_quantity") > 25, "R").otherwise("A"))
    return _rounded(evaluation.expected_cost(t, "l_returnflag", "p", costs), "mean_cost")


_register(
    "prediction_rows", "lineitem", lambda t: _rounded(evaluation.predictions(t.withColumn("d", F.array(F.col("l_discount") * 5, 1 - F.col("l_discount") * 5)), "l_linestatus", "l_returnflag", "d", ["F", "O"]).groupBy("actual", "margin").count(), "margin"),
    "SELECT l_linestatus AS actual, round(CASE WHEN l_linestatus = 'F' THEN l_discount * 10 - 1 ELSE 1 - l_discount * 10 END, 6) AS margin, count(*) AS count FROM lineitem GROUP BY 1, l_linestatus, l_discount",
)
_register("numeric_predictions", "lineitem", lambda t: _rounded(evaluation.predictions(t, "l_discount", "l_tax").groupBy("actual", "predicted", "error").count(), "error"), "SELECT l_discount AS actual, l_tax AS predicted, round(l_tax - l_discount, 6) AS error, count(*) AS count FROM lineitem GROUP BY 1, 2")
_RESULTS = "WITH r AS (SELECT l_returnflag AS scheme, l_linenumber AS run, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) "


def _results(t):
    return t.groupBy(F.col("l_returnflag").alias("scheme"), F.col("l_linenumber").alias("run")).agg(F.avg("l_quantity").alias("v"))


_register("wins_and_losses", "lineitem", lambda t: evaluation.wins(_results(t), ["run"], "scheme", "v"), _RESULTS + "SELECT a.scheme, CAST(count(*) FILTER (a.v > b.v) AS BIGINT) AS wins, CAST(count(*) FILTER (a.v < b.v) AS BIGINT) AS losses FROM r a JOIN r b ON a.run = b.run AND a.scheme <> b.scheme GROUP BY 1")
_register("averaged_results", "lineitem", lambda t: _rounded(evaluation.averaged(_results(t), ["scheme"], ["v"]), "avg_v", "sd_v"), _RESULTS + "SELECT scheme, count(*) AS n, round(avg(v), 6) AS avg_v, round(stddev_samp(v), 6) AS sd_v FROM r GROUP BY 1")
for _name, _share in (("paired_tests", 0.0), ("corrected_paired_tests", 0.5)):
    _register(
        _name, "lineitem", lambda t, share=_share: _rounded(evaluation.paired_test(_results(t).where("run <= 3"), ["run"], "scheme", "v", "A", share), "mean_difference", "t", "p", places=5),
        f"{_RESULTS}, p AS (SELECT b.scheme, b.v - a.v AS d FROM r a JOIN r b ON a.run = b.run AND a.scheme = 'A' AND b.scheme <> 'A' WHERE a.run <= 3), s AS (SELECT scheme, count(*) AS n, avg(d) AS m, avg(d) / sqrt((1.0 / count(*) + {_share}) * var_samp(d)) AS t FROM p GROUP BY 1) "
        "SELECT scheme, n, round(m, 5) AS mean_difference, round(t, 5) AS t, round(1 - abs(t) / sqrt(2 + t * t), 5) AS p FROM s",
    )
_M = "SELECT l_linestatus AS s, avg(l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1"


@query(
    "rendered_matrix",
    f"WITH m AS ({_M}), f AS (SELECT s, coalesce(format('{{:.2f}}', a), '') AS a, coalesce(format('{{:.2f}}', r), '') AS r, a AS x, r AS y FROM m) "
    "SELECT 'csv' AS form, s || ',' || a || ',' || r AS line FROM f UNION ALL SELECT 'html', '<tr><td>' || s || '</td><td>' || a || '</td><td>' || r || '</td></tr>' FROM f UNION ALL SELECT 'latex', s || ' & ' || a || ' & ' || r || ' \\\\' FROM f UNION ALL "
    "SELECT 'gnuplot', s || ' ' || a || ' ' || r FROM f UNION ALL SELECT 'text', rpad(s, 20, ' ') || ' ' || lpad(a, 12, ' ') || ' ' || lpad(r, 12, ' ') FROM f UNION ALL SELECT 'significance', s || ' ' || CASE WHEN x > 0 THEN 'v' ELSE ' ' END || ' ' || CASE WHEN y > 0 THEN 'v' ELSE ' ' END FROM f",
)
def rendered_matrix(spark, d):
    m = evaluation.result_matrix(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", ["A", "R"])
    found = [evaluation.rendered(m, "l_linestatus", ["A", "R"], f, title="status").where("place like '1%'").select(F.lit(f).alias("form"), "line") for f in ("csv", "html", "latex", "gnuplot", "text", "significance")]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


@query("located_columns", "SELECT * FROM (VALUES ('bag.l_linenumber', 'numeric'), ('bag.l_shipdate', 'date'), ('l_linestatus', 'string'), ('bag.l_comment', 'string'), ('l_orderkey', 'numeric'), ('bag', 'relational')) AS t(path, kind)")
def located_columns(spark, d):
    from millrace.operators import reshape

    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_returnflag").alias("l_comment"), "l_linestatus")
    bags = reshape.to_bags(t, "l_orderkey", "l_linestatus", ["l_linenumber"])
    return spark.createDataFrame([(p, k) for k in ("numeric", "string", "date", "relational") for p in C.located(bags, k)], "path string, kind string")


_register("one_column", "part", lambda t: t.select(C.column_index(t, "first"), C.column_index(t, "last"), C.column_index(t, "2")), "SELECT p_partkey, p_retailprice, p_name FROM part")
