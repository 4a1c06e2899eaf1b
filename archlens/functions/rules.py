"""Ordered classification rules, compiled to one column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from archlens.functions.names import SPECIAL_FILES, base_name, is_builtin_hook, is_component_name


@dataclass(frozen=True)
class Rule:
    """A type, and the patterns of which any one gives it: name regexes, parts of imports, parts of tags."""

    type: str
    names: Sequence[str] = field(default_factory=tuple)
    imports: Sequence[str] = field(default_factory=tuple)
    tags: Sequence[str] = field(default_factory=tuple)

    def holds(self, name: Column, imports: Column, tags: Column) -> Column:
        found = F.lit(False)
        for pattern in self.names:
            found |= name.rlike(pattern)
        if self.imports:
            found |= F.exists(imports, lambda x: _any(F.contains(x, F.lit(p)) for p in self.imports))
        if self.tags:
            found |= F.exists(tags, lambda x: _any(F.contains(x, F.lit(p)) for p in self.tags))
        return F.coalesce(found, F.lit(False))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


#: The default rules, in their order.
DEFAULT_RULES = (
    Rule("provider", ["(?i)provider$", "(?i)context$"]),
    Rule(
        "dialog", ["(?i)dialog", "(?i)modal", "(?i)sheet", "(?i)drawer", "(?i)popover"],
        ["@radix-ui/react-dialog", "@radix-ui/react-alert-dialog", "@radix-ui/react-popover", "@headlessui/react"],
        ["Dialog", "Modal", "Sheet", "AlertDialog", "Drawer", "Popover"],
    ),
    Rule(
        "grid", ["(?i)grid", "(?i)table"], ["@tanstack/react-table", "ag-grid-react", "@ag-grid-community", "@mui/x-data-grid"],
        ["DataGrid", "AgGridReact", "Table", "DataTable"],
    ),
    Rule(
        "chart", ["(?i)chart", "(?i)graph(?!ql)", "(?i)sparkline", "(?i)visualization"],
        ["recharts", "echarts", "apexcharts", "react-apexcharts", "echarts-for-react", "victory", "@nivo", "chart.js", "react-chartjs-2", "d3"],
        ["BarChart", "LineChart", "PieChart", "AreaChart", "RadarChart", "ScatterChart", "ResponsiveContainer", "Chart"],
    ),
)

#: Signs of a context provider in a source text.
PROVIDER_SIGNS = r"\.Provider\s*[>/]|createContext\s*[<(]|Context\.Provider|\.Provider\s*value="


def classify(name: Column, imports: Column, tags: Column, path: Column, source: Column | None = None, custom: Sequence[Rule] = ()) -> Column:
    """The type of the first rule that holds (custom rules first), else by ``createContext``, else by file name."""
    out = None
    for rule in [*custom, *DEFAULT_RULES]:
        held = rule.holds(name, imports, tags)
        out = F.when(held, rule.type) if out is None else out.when(held, rule.type)
    if source is not None:
        out = out.when(F.coalesce(source.rlike(r"createContext\s*[<(]"), F.lit(False)), "provider")
    base = base_name(path)
    return out.when(base.isin(SPECIAL_FILES), base).otherwise("component")


def classify_export(name: Column, path: Column) -> Column:
    """What an imported name is, by its form and the file it comes from."""
    return (
        F.when(name.rlike("^use[A-Z]"), F.when(is_builtin_hook(name), "unknown").otherwise("hook"))
        .when(name.rlike("(?i)(provider|context)$"), "provider")
        .when(is_component_name(name), "component")
        .when(path.rlike(r"(?i)\butils?\b|\blib\b|\bhelpers?\b"), "util")
        .when(path.rlike(r"(?i)\bhooks?\b"), "hook")
        .when(name.rlike("^[a-z]"), "util")
        .otherwise("unknown")
    )


def has_provider_sign(source: Column) -> Column:
    return source.rlike(PROVIDER_SIGNS)
