"""Record schemas. Every record also carries `ord`, its place of arrival, which decides what comes first or last."""

FUNCTION = "name string, fullName string, file string, line int, signature string, isExternal boolean, subsystem string"
PARAMETER = "functionName string, name string, position int, typeFullName string"
BRANCH_POINT = "branchType string, function string, conditionOp string, conditionLHS string, conditionRHS string, conditionRHSValue bigint, rawCondition string, source string, conditionRHSLabel string, lhsArgPos int"
INDIRECT_CALL = "callerFunction string, callExpression string, file string, line int"
FNPTR_ASSIGNMENT = "structType string, fieldName string, targetFn string, sourceFile string, line int, arrayIndex bigint, source string"
CALL_EDGE = "callerFn string, calleeFn string, file string, line int, source string"
DATAFLOW_EDGE = "callerFn string, calleeFn string, callerArgPos int, calleeParamPos int, callerArgCode string, calleeParamName string"
INDIRECT_CALL_EDGE = "callerFn string, callExpression string, file string, line int, argCount int, argCodes array<string>"
CONSTANT = "name string, value bigint, source string"
RESOLVES_TO = "callerFunction string, callExpression string, target string, resolvedBy string, arrayIndex bigint, state string, validUntil bigint"

#: Records of node files by nodeType, of edge files by edgeType; a BranchCondition is a branch found by the compiler.
NODES = {"Function": FUNCTION, "Parameter": PARAMETER, "BranchPoint": BRANCH_POINT, "BranchCondition": BRANCH_POINT, "IndirectCall": INDIRECT_CALL, "FnPtrAssignment": FNPTR_ASSIGNMENT}
EDGES = {"CallEdge": CALL_EDGE, "DataFlowEdge": DATAFLOW_EDGE, "IndirectCallEdge": INDIRECT_CALL_EDGE}
#: The compiler's records of a translation unit, all in one shape; conditionRHSValue is a string until it is checked.
UNIT = (
    "type string, callerFn string, calleeFn string, file string, line int, callExpr string, argCount int, structType string, fieldName string, targetFn string, sourceFile string, "
    "context string, arrayIndex bigint, function string, conditionOp string, conditionLHS string, conditionRHSLabel string, conditionRHSValue string, lhsArgPos int"
)
REQUIRED = {
    "CallEdge": ("callerFn", "calleeFn", "file"),
    "FnPtrAssignment": ("fieldName", "targetFn", "sourceFile"),
    "BranchCondition": ("function", "conditionOp", "conditionLHS", "conditionRHSValue"),
}


def merged(*schemas: str) -> str:
    """One schema with the columns of several, each once."""
    from pyspark.sql.types import StructType

    fields = {f.name: f for s in schemas for f in StructType.fromDDL(s).fields}
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.values())
