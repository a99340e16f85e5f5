"""Activities that the compiler is known to record, and what their detail holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of activities by the type of their argument.
BY_TYPE: dict[str, tuple[str, ...]] = {
    "Nothing": (
        "Backend",
        "CodeGenPasses",
        "CoroSplitPass",
        "ExecuteCompiler",
        "Frontend",
        "OpenMPOptCGSCCPass",
        "Optimizer",
        "PassManager<llvm::Loop, llvm::LoopAnalysisManager, llvm::LoopStandardAnalysisResults &, llvm::LPMUpdater &>",
        "PerformPendingInstantiations",
        "PerFunctionPasses",
        "PerModulePasses",
    ),
    "String": (
        "RunLoopPass",
        "RunPass",
    ),
    "FilePathOrModule": (
        "Annotation2MetadataPass",
        "AssignmentTrackingPass",
        "CalledValuePropagationPass",
        "CallGraphAnalysis",
        "CGProfilePass",
        "ConstantMergePass",
        "DeadArgumentEliminationPass",
        "EliminateAvailableExternallyPass",
        "ForceFunctionAttrsPass",
        "GlobalDCEPass",
        "GlobalOptPass",
        "GlobalsAA",
        "InferFunctionAttrsPass",
        "InnerAnalysisManagerProxy<CGSCCAnalysisManager, Module>",
        "IPSCCPPass",
        "LazyCallGraphAnalysis",
        "ModuleInlinerWrapperPass",
        "ModuleToFunctionPassAdaptor",
        "ModuleToPostOrderCGSCCPassAdaptor",
        "OpenMPOptPass",
        "OptModule",
        "RecomputeGlobalsAAPass",
        "RelLookupTableConverterPass",
        "RequireAnalysisPass<llvm::GlobalsAA, llvm::Module>",
        "RequireAnalysisPass<llvm::ProfileSummaryAnalysis, llvm::Module>",
        "RequireAnalysisPass<llvm::GlobalsAA, llvm::Module, llvm::AnalysisManager<Module>>",
        "ReversePostOrderFunctionAttrsPass",
        "Source",
    ),
    "CppEntity": (
        "CodeGen Function",
        "DebugConstGlobalVariable",
        "DebugFunction",
        "DebugGlobalVariable",
        "DebugType",
        "InstantiateClass",
        "InstantiateFunction",
        "ParseClass",
        "ParseTemplate",
    ),
    "Symbol": (
        "AAManager",
        "ADCEPass",
        "AggressiveInstCombinePass",
        "AlignmentFromAssumptionsPass",
        "AnnotationRemarksPass",
        "BDCEPass",
        "BlockFrequencyAnalysis",
        "BranchProbabilityAnalysis",
        "ConstraintEliminationPass",
        "CoroCleanupPass",
        "CoroEarlyPass",
        "CoroElidePass",
        "CorrelatedValuePropagationPass",
        "DivRemPairsPass",
        "DominatorTreeAnalysis",
        "DSEPass",
        "EarlyCSEPass",
        "Float2IntPass",
        "FunctionToLoopPassAdaptor",
        "GVNPass",
        "InjectTLIMappings",
        "InstCombinePass",
        "InstSimplifyPass",
        "InvalidateAnalysisPass<llvm::AAManager>",
        "InvalidateAnalysisPass<llvm::ShouldNotRunFunctionPassesAnalysis>",
        "JumpThreadingPass",
        "LCSSAPass",
        "LibCallsShrinkWrapPass",
        "LoopAnalysis",
        "LoopDistributePass",
        "LoopLoadEliminationPass",
        "LoopSimplifyPass",
        "LoopSinkPass",
        "LoopUnrollPass",
        "LoopVectorizePass",
        "LowerConstantIntrinsicsPass",
        "LowerExpectIntrinsicPass",
        "MemCpyOptPass",
        "MemorySSAAnalysis",
        "MergedLoadStoreMotionPass",
        "OptFunction",
        "PassManager<LazyCallGraph::SCC, CGSCCAnalysisManager, LazyCallGraph &, CGSCCUpdateResult &>",
        "PostDominatorTreeAnalysis",
        "PromotePass",
        "ReassociatePass",
        "RequireAnalysisPass<llvm::OptimizationRemarkEmitterAnalysis, llvm::Function>",
        "ScalarEvolutionAnalysis",
        "SCCPPass",
        "SimplifyCFGPass",
        "SLPVectorizerPass",
        "SpeculativeExecutionPass",
        "SROAPass",
        "TailCallElimPass",
        "TargetIRAnalysis",
        "VectorCombinePass",
        "WarnMissedTransformationsPass",
    ),
    "SymbolOpt": (
        "CGSCCToFunctionPassAdaptor",
        "DevirtSCCRepeatedPass",
        "InlinerPass",
        "PassManager<llvm::Function>",
        "PassManager<Function>",
        "PostOrderFunctionAttrsPass",
    ),
    "UnnamedLoop": (
        "IndVarSimplifyPass",
        "LoopDeletionPass",
        "LoopFullUnrollPass",
        "LoopIdiomRecognizePass",
        "LoopInstSimplifyPass",
        "LoopRotatePass",
        "LoopSimplifyCFGPass",
        "PassManager<Loop, LoopAnalysisManager, LoopStandardAnalysisResults &, LPMUpdater &>",
        "SimpleLoopUnswitchPass",
    ),
    "UnnamedLoopOpt": (
        "LICMPass",
    ),
}


def activity_types() -> dict[str, str]:
    return {name: kind for kind, names in BY_TYPE.items() for name in names}


def dim_activity(spark: SparkSession) -> DataFrame:
    """(activity, catalogue_type): about 120 rows, so that it may always be broadcast."""
    return spark.createDataFrame(sorted(activity_types().items()), "activity string, catalogue_type string")
