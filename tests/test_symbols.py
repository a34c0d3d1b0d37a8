"""Symbol extraction on small sources."""

from samples import files_of

from sourceweave.operators import models as mo
from sourceweave.operators import symbols as sy

PY = '''
import csv
import gzip as gz
from pathlib import Path, PurePath as Pure

RATE: float = 0.2


@registry.tariff(zone=3)
@traced
def quote(weight, *extras: int, zone: str = "north") -> Money:
    '''+"'''"+'''Price of one parcel.'''+"'''"+'''
    base = lookup(zone)
    return base * weight


class Depot(Site, kind="hub"):
    """Where parcels wait."""

    shelves = 40

    async def unload(
        self,
        truck: Truck,
    ):
        def sorter(parcel):
            return place(parcel)

        return sorter(truck)
'''
JS = """
import axios from 'axios';
import { join, parse as read } from './paths';
import * as zones from './zones';
const double = (n) => n + n;
const route = async (from, to) => {
  return plan(from, to);
};
export class Depot extends Site {
  unload(truck) {
    while (truck) {
      truck = double(truck);
    }
  }
}
"""
TS = """
export interface Parcel {
    weight: number;
    label?: string;
}
export function ship(p: Parcel, days = 2): Promise<void> {
    return send(p);
}
"""
JAVA = """
class Yard {
    Bay open(int n) {
        return bays.get(n);
    }

    public static <T extends Bay> List<T> sorted(List<T> in) throws IOException {
        if (in == null) {
            return copy(in);
        } else if (done(in)) {
            return in;
        }
        return in;
    }
}
"""
GO = """
type Stack[T any] struct {
	items []T
}

func (s *Stack[T]) Push(x T) error {
	return nil
}

func Fold[T, A any](xs []T, start A) A {
	return start
}
"""


def test_python_functions(spark):
    f = {r["name"]: r for r in sy.extract_functions(files_of(spark, depot_py=PY)).collect()}
    assert set(f) == {"quote", "unload"}
    q = f["quote"]
    assert (q["start_line"], q["end_line"], q["return_type"], q["docstring"]) == (11, 14, "Money", "Price of one parcel.")
    assert q["decorators"] == ["registry.tariff(zone=3)", "traced"] and not q["is_async"] and not q["is_method"]
    u = f["unload"]
    assert u["is_async"] and u["is_method"] and u["class_name"] == "Depot" and u["end_line"] == 29


def test_python_parameters_and_classes(spark):
    files = files_of(spark, depot_py=PY)
    rows = sy.extract_parameters(sy.extract_functions(files)).where("function = 'quote'").orderBy("ordinal").collect()
    assert [(r["name"], r["type"], r["default_value"]) for r in rows] == [("weight", "", ""), ("*extras", "int", ""), ("zone", "str", '"north"')]
    classes = sy.extract_classes(files)
    (c,) = classes.collect()
    assert (c["name"], c["base_classes"], c["method_count"], c["docstring"]) == ("Depot", "Site", 1, "Where parcels wait.")
    assert [(r["name"], r["value"]) for r in sy.extract_attributes(classes).collect()] == [("shelves", "40")]


def test_python_imports_variables_calls(spark):
    files = files_of(spark, depot_py=PY)
    imports = {r["module"]: r["names"] for r in sy.extract_imports(files).collect()}
    assert set(imports) == {"csv", "gzip as gz", "pathlib"} and imports["pathlib"] == ["Path", "PurePath as Pure"]
    assert [(r["name"], r["type"], r["value"]) for r in sy.extract_variables(files).collect()] == [("RATE", "float", "0.2")]
    calls = {(r["caller"], r["callee"]) for r in sy.extract_calls(files).collect()}
    assert {("quote", "lookup"), ("sorter", "place"), ("unload", "sorter"), ("", "registry.tariff")} <= calls


def test_scripts(spark):
    files = files_of(spark, a_js=JS, b_ts=TS)
    names = {(r["path"], r["name"], r["class_name"]) for r in sy.extract_functions(files).collect()}
    assert names == {("a.js", "double", ""), ("a.js", "route", ""), ("a.js", "unload", "Depot"), ("b.ts", "ship", "")}
    assert {(r["name"], r["base_classes"]) for r in sy.extract_classes(files).collect()} == {("Depot", "Site"), ("Parcel", "")}
    (ship,) = sy.extract_functions(files).where("path = 'b.ts'").collect()
    assert ship["return_type"] == "Promise<void>"
    imports = [r["names"] for r in sy.extract_imports(files).orderBy("ordinal").collect()]
    assert imports == [["axios"], ["join", "parse as read"], ["* as zones"]]
    assert "double" in {r["callee"] for r in sy.extract_calls(files).collect()}


def test_java_without_modifiers_and_generics(spark):
    f = {(r["name"], r["class_name"], r["return_type"]) for r in sy.extract_functions(files_of(spark, Yard_java=JAVA)).collect()}
    assert f == {("open", "Yard", "Bay"), ("sorted", "Yard", "List<T>")}
    calls = {(r["caller"], r["callee"]) for r in sy.extract_calls(files_of(spark, Yard_java=JAVA)).collect()}
    assert calls == {("open", "bays.get"), ("sorted", "copy"), ("sorted", "done")}


def test_go_generics(spark):
    files = files_of(spark, stack_go=GO)
    f = {(r["name"], r["class_name"], r["is_method"]) for r in sy.extract_functions(files).collect()}
    assert f == {("Push", "Stack", True), ("Fold", "", False)}
    assert [r["name"] for r in sy.extract_classes(files).collect()] == ["Stack"]


def test_entities_with_decorators_between(spark):
    ts = '@Entity("bays")\n@Index(["n"])\nexport class Bay {\n  @Column() n: number;\n}\n@Entity("yards")\nexport class Yard {\n  @Column() m: string;\n}\n'
    got = [(r["name"], r["table_name"], r["line_no"], len(r["fields"])) for r in mo.extract_models(files_of(spark, m_ts=ts), "typeorm").orderBy("line_no").collect()]
    assert got == [("Bay", "bays", 1, 1), ("Yard", "yards", 6, 1)]


def test_spans_nest(spark):
    spans = sy.block_spans(files_of(spark, a_py=PY, b_js=JS)).collect()
    for r in spans:
        assert r["start_line"] <= r["end_line"]
        for o in spans:
            if o["path"] == r["path"]:
                apart = o["end_line"] < r["start_line"] or o["start_line"] > r["end_line"]
                inside = (o["start_line"] >= r["start_line"] and o["end_line"] <= r["end_line"]) or (
                    r["start_line"] >= o["start_line"] and r["end_line"] <= o["end_line"]
                )
                assert apart or inside
