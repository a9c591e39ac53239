import typing

import pytest
from pyspark.sql import types as T

from tessel.contracts import (
    F32, I8, I32, U32, U64, Char, ContractMismatch, ContractViolation, DiffKind, Field, Map, MappingError, Optional, Policy, Primitive, Sequence, Struct,
    Validator, compare, conforms, contract, default, enforce, ingest_violation, shape_from_spark, shape_of, struct_type,
)

ALL = list(Policy)
EXACTS = [Policy.EXACT, Policy.EXACT_UNORDERED_CI, Policy.EXACT_ORDERED, Policy.EXACT_ORDERED_CI, Policy.EXACT_BY_POSITION]


def struct(**fields):
    return Struct(tuple(Field(n, Primitive(s) if isinstance(s, str) else s) for n, s in fields.items()))


def accepted(p, c):
    return {x for x in ALL if conforms(p, c, x)}


def test_equal_shapes_conform_under_all():
    s = struct(id="i64", note=Optional(Primitive("String")))
    assert accepted(s, s) == set(ALL)


def test_case_and_order():
    a, b = struct(id="i64", name="String"), struct(NAME="String", ID="i64")
    assert accepted(a, b) == {Policy.EXACT, Policy.EXACT_UNORDERED_CI, Policy.FULL}
    assert accepted(struct(ID="i64", Name="String"), a) == {Policy.EXACT, Policy.EXACT_UNORDERED_CI, Policy.EXACT_ORDERED_CI, Policy.EXACT_BY_POSITION, Policy.FULL}
    assert accepted(struct(x="i64", y="String"), a) == {Policy.EXACT_BY_POSITION, Policy.FULL}


def test_case_folding_is_ascii_only():
    assert not conforms(struct(É="i64"), struct(é="i64"), Policy.EXACT)


def test_extra_and_missing():
    small, large = struct(id="i64"), struct(id="i64", note="String")
    assert accepted(large, small) == {Policy.BACKWARD, Policy.FULL}
    assert accepted(small, large) == {Policy.FORWARD, Policy.FULL}
    assert accepted(small, struct(id="i64", note=Optional(Primitive("String")))) == {Policy.BACKWARD, Policy.FORWARD, Policy.FULL}
    with_default = Struct((Field("id", Primitive("i64")), Field("note", Primitive("String"), has_default=True)))
    assert conforms(small, with_default, Policy.BACKWARD)
    assert {d.note for d in compare(small, with_default, Policy.BACKWARD)} == {"default"}


def test_ordered_name_mismatch_still_recurses():
    diffs = compare(struct(a="i32"), struct(b="i64"), Policy.EXACT_ORDERED)
    assert [(d.path, d.expected, d.found) for d in diffs] == [(("b", "(name)"), "b", "a"), (("b",), "i64", "i32")]


def test_nested_paths():
    p = struct(ship=struct(zip="String", items=Sequence(struct(n="i32")), by=Map(Primitive("String"), Primitive("i64"))))
    c = struct(ship=struct(zip="i64", items=Sequence(struct(n="i64")), by=Map(Primitive("i32"), Primitive("i32"))))
    assert [".".join(d.path) for d in compare(p, c, Policy.EXACT)] == ["ship.zip", "ship.items.[].n", "ship.by.<key>", "ship.by.<value>"]


def test_optional_is_a_kind_of_its_own():
    (d,) = compare(struct(customer_name="String"), struct(customer_name=Optional(Primitive("String"))), Policy.EXACT)
    assert str(d) == "mismatch `customer_name` (expected `Optional`, found `String`)"
    assert conforms(struct(x="i32"), struct(x=Optional(Primitive("i32"))), Policy.FULL)


@pytest.mark.parametrize("policy", [Policy.EXACT, Policy.BACKWARD, Policy.FORWARD])
def test_repeated_names_are_ambiguous_by_name(policy):
    twice = Struct((Field("a", Primitive("i32")), Field("a", Primitive("i32"))))
    (d,) = compare(twice, twice, policy)
    assert d.expected == "unique field name" and not conforms(twice, twice, policy)
    assert conforms(twice, twice, Policy.EXACT_BY_POSITION)


def test_position_path_uses_the_producers_name():
    assert compare(struct(mine="i32"), struct(theirs="i64"), Policy.EXACT_BY_POSITION)[0].path == ("mine",)


def test_roots():
    a, b = Primitive("i32"), Primitive("i64")
    assert compare(a, b, Policy.EXACT)[0].path == ("<root>",)
    assert conforms(a, b, Policy.FULL) and not conforms(a, b, Policy.BACKWARD)


def test_tolerated_differences_never_hide_a_rejected_one():
    p = struct(**{f"x{k}": "i32" for k in range(300)}, y="i32")
    assert not conforms(p, struct(y="i64"), Policy.BACKWARD)
    assert sum(d.kind is DiffKind.EXTRA for d in compare(p, struct(y="i64"), Policy.BACKWARD)) == 300


def test_derive(spark):
    @contract
    class Child:
        count: I32

    @contract
    class Parent:
        child: typing.Optional[Child]
        items: list[typing.Optional[str]]
        lookup: dict[str, typing.Optional[int]]
        required: bool = default()
        wide: U32 = default()

    assert struct_type(Parent).simpleString() == "struct<child:struct<count:int>,items:array<string>,lookup:map<string,bigint>,required:boolean,wide:bigint>"
    assert [f.nullable for f in struct_type(Parent)] == [True, False, False, False, False]
    assert struct_type(Parent)["wide"].metadata == {"logical": "u32"}
    assert shape_of(Parent).fields[3].has_default and not shape_of(Parent).fields[0].has_default
    assert shape_from_spark(struct_type(Parent)) == Struct(tuple(Field(f.name, f.shape) for f in shape_of(Parent).fields))
    assert str(Parent.c.items) == "Column<'items'>"
    with pytest.raises(AttributeError):
        Parent.c.renamed
    with pytest.raises(ContractMismatch, match="count"):
        enforce(Parent, Child, Policy.EXACT)


def test_derive_refuses():
    X = typing.TypeVar("X")
    with pytest.raises(TypeError, match="generic"):

        @contract
        class G(typing.Generic[X]):
            x: int

    with pytest.raises(TypeError, match="named fields"):

        @contract
        class Empty:
            pass

    with pytest.raises(TypeError, match="map keys"):
        shape_of(dict[float, int])


@pytest.mark.parametrize(
    ("shape", "kind"),
    [
        (Primitive("i32"), "RootNotStruct"),
        (struct(x="char"), "UnsupportedPrimitive"),
        (struct(x="i128"), "UnsupportedPrimitive"),
        (struct(x=Optional(Optional(Primitive("i32")))), "NestedOptional"),
        (struct(x=Map(Primitive("f64"), Primitive("i32"))), "InvalidMapKey"),
        (Struct((Field("x", Primitive("i32")), Field("x", Primitive("i32")))), "DuplicateField"),
    ],
)
def test_mapping_errors(shape, kind):
    with pytest.raises(MappingError) as e:
        struct_type(shape)
    assert e.value.kind == kind


def test_depth_limit():
    s = Primitive("i32")
    for _ in range(130):
        s = Sequence(s)
    with pytest.raises(MappingError, match="DepthLimit"):
        struct_type(struct(x=s))


def test_all_widths():
    @contract
    class W:
        a: I8
        b: F32
        c: U64
        d: Char

    assert struct_type(Struct(shape_of(W).fields[:3])).simpleString() == "struct<a:tinyint,b:float,c:decimal(20,0)>"


def test_validator(spark):
    schema = T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("child", T.StructType([T.StructField("n", T.IntegerType(), False)]), True),
            T.StructField("xs", T.ArrayType(T.StructType([T.StructField("v", T.IntegerType(), False)]), True), True),
            T.StructField("m", T.MapType(T.StringType(), T.IntegerType(), False), True),
        ]
    )
    v = Validator.of(schema)
    loose = "id bigint, child struct<n:int>, xs array<struct<v:int>>, m map<string,int>"
    good = spark.createDataFrame([(1, None, None, None), (2, (3,), [None, (1,)], {"a": 1})], loose)
    v.check(good)
    bad = spark.createDataFrame([(None, (None,), [(None,)], {"a": None})], loose)
    assert {r.path: r.n_rows for r in v.violations(bad).collect()} == {"id": 1, "child.n": 1, "xs.[].v": 1, "m.<value>": 1}
    with pytest.raises(ContractViolation) as e:
        v.check(bad)
    assert (e.value.kind, e.value.path) == ("NullValue", "id")
    assert all(r.n_rows == 0 for r in v.violations(good.limit(0)).collect())


def test_ingest_contract_first_violation_wins(spark):
    ok = spark.createDataFrame([(1, "", None)], "id bigint, name string, note string")
    assert ingest_violation(ok) is None
    assert ingest_violation(ok.select("id", "name")).kind == "ColumnCount"
    assert ingest_violation(ok.toDF("id", "title", "note")).kind == "Name"
    assert ingest_violation(ok.selectExpr("cast(id as int) id", "name", "note")).kind == "Type"
    assert ingest_violation(spark.createDataFrame([(None, "a", "b")], "id bigint, name string, note string")).path == "id"
