"""Column functions: math, dates, paths, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function of x held to [-40, 40]."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(held / (1 - held))


def entropy_share(value: Column, total: Column) -> Column:
    """One term of an entropy in bits; nothing for values that are not positive."""
    return F.when(value > 0, -(value / total) * F.log2(value / total)).otherwise(F.lit(0.0))


def text_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for the empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.array_distinct(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(kinds, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def round_binary(x: Column, digits: int = 4) -> Column:
    """A double rounded to decimal digits as its exact binary value asks for, ties to even; digits from 0 to 22.

    x 10^digits is a double p and what p leaves out, both exact by Dekker's product (10^digits is a double itself). p alone decides but
    for a half, where the rest's sign does. Values of 2^53 and more after scaling have no digits to lose; infinities and
    NaN stay.
    """
    scale = 10.0**digits
    high = lambda a: 134217729.0 * a - (134217729.0 * a - a)
    x = x.cast("double")
    p, top = x * scale, float(high(scale))
    xh = high(x)
    rest = ((xh * top - p) + xh * (scale - top) + (x - xh) * top) + (x - xh) * (scale - top)
    whole = F.rint(p)
    half = p - whole  # exact
    whole = F.when((half == 0.5) & (rest > 0), whole + 1).when((half == -0.5) & (rest < 0), whole - 1).otherwise(whole)
    return F.when(F.abs(p) < 9007199254740992.0, whole / scale).otherwise(x)


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Exact decimal rounding, halves away from zero."""
    return F.round(x.cast("decimal(38,10)"), digits)


def round_down(x: Column, digits: int = 2) -> Column:
    """Exact decimal rounding toward zero."""
    scale = 10**digits
    d = x.cast("decimal(30,8)") * scale
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)) / F.lit(scale).cast("decimal(10,0)")


def iso_timestamp(text: Column) -> Column:
    """A timestamp of ISO text, Z included; null if it is not one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def days_between(later: Column, earlier: Column) -> Column:
    """Days, with fractions, between two times in seconds."""
    return (later - earlier) / 86400.0


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("bigint")


def routing_tolerance(weight: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.05), 3 * F.sqrt(weight * (1 - weight) / n))


def is_test_path(path: Column) -> Column:
    """The graph's rule: a folder tests, or a file whose name starts with test_."""
    return path.rlike(r"(^|/)tests/") | path.rlike(r"(^|/)test_[^/]*$")


def is_test_source(path: Column) -> Column:
    """The history's rule, which also takes *_test.py."""
    return is_test_path(path) | path.endswith("_test.py")


#: Fixed patterns of file classes.
DEPENDENCY_FILES = r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|setup\.(py|cfg)|Pipfile(\.lock)?|poetry\.lock|package(-lock)?\.json)$"
CI_FILES = r"(^|/)(\.github/|\.gitlab-ci\.yml|Dockerfile|docker-compose[^/]*\.ya?ml|Makefile|action\.ya?ml)"
CONFIG_FILES = r"\.(ya?ml|ini|cfg|toml|json|env)$|(^|/)\.env"
DOC_FILES = r"(?i)\.(md|rst|txt)$|(^|/)docs/"


def file_class(path: Column) -> Column:
    return F.when(path.rlike(DEPENDENCY_FILES), "dependency").when(path.rlike(CI_FILES), "ci").when(path.rlike(CONFIG_FILES), "config").when(path.rlike(DOC_FILES), "docs").otherwise("source")


def intent(title: Column, paths: Column) -> Column:
    """test, docs, config, bugfix, refactor or feature."""
    some = F.size(paths) > 0
    low = F.lower(title)
    return (
        F.when(some & F.forall(paths, is_test_path), "test")
        .when(some & F.forall(paths, lambda p: p.rlike(DOC_FILES)), "docs")
        .when(some & F.forall(paths, lambda p: p.rlike(CONFIG_FILES) | p.rlike(DEPENDENCY_FILES) | p.rlike(CI_FILES)), "config")
        .when(low.rlike(r"\b(fix|bug|crash|regression|wrong|incorrect|broken)\b"), "bugfix")
        .when(low.rlike(r"\b(refactor|rename|clean ?up|tidy|simplify|extract|move|reformat)\b"), "refactor")
        .otherwise("feature")
    )


def meaningful(line: Column) -> Column:
    """A line of code that is neither blank nor a comment."""
    return (F.trim(line) != "") & ~F.trim(line).startswith("#")


def executable(line: Column) -> Column:
    return meaningful(line) & ~F.trim(line).rlike("^(\"\"\"|''')")


def function_key(test_id: Column) -> Column:
    """A test's id without its parameters."""
    return F.substring_index(test_id, "[", 1)


def test_node(test_id: Column) -> Column:
    """path::Class::name[param] to path::Class.name."""
    plain = function_key(test_id)
    path = F.substring_index(plain, "::", 1)
    rest = F.regexp_replace(plain, r"^[^:]*::", "")
    return F.concat(F.lit("sym:"), path, F.lit("::"), F.replace(rest, F.lit("::"), F.lit(".")))


def fingerprint(files: Column, digits: int = 16) -> Column:
    """A digest of an array of (path, content hash) strings that does not depend on their order."""
    return F.left(F.sha2(F.array_join(F.array_sort(files), "\n"), 256), F.lit(digits))


def term_order(term: Column) -> Column:
    """2024-SPRING < 2024-SUMMER < 2024-FALL < 2025-SPRING."""
    return F.substring_index(term, "-", 1).cast("int") * 3 + F.array_position(F.array(F.lit("SPRING"), F.lit("SUMMER"), F.lit("FALL")), F.substring_index(term, "-", -1)).cast("int")


def rename_side(path: Column, new: bool = True) -> Column:
    """The old or new path of a numstat entry with { a => b } or a => b."""
    k = 2 if new else 1
    braced = F.regexp_replace(F.concat(F.regexp_extract(path, r"^(.*)\{(.*) => (.*)\}(.*)$", 1), F.regexp_extract(path, r"^(.*)\{(.*) => (.*)\}(.*)$", 1 + k), F.regexp_extract(path, r"^(.*)\{(.*) => (.*)\}(.*)$", 4)), "//", "/")
    return F.when(path.rlike(r"\{.* => .*\}"), braced).when(path.contains(" => "), F.split(path, " => ")[k - 1]).otherwise(path)
