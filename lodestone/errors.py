"""What graph construction and algorithms can refuse. "Not applicable" results are None or empty, not errors."""


class GraphError(Exception):
    """Base of all graph errors."""


def _error(name: str, doc: str) -> type[GraphError]:
    return type(name, (GraphError,), {"__doc__": doc, "__module__": __name__})


EmptyNodeId = _error("EmptyNodeId", "A node id is empty.")
InvalidKind = _error("InvalidKind", "A kind is empty or has white space around it.")
ConflictingNode = _error("ConflictingNode", "One id has different definitions.")
MissingEdgeSource = _error("MissingEdgeSource", "An edge's source doesn't exist.")
MissingEdgeTarget = _error("MissingEdgeTarget", "An edge's target doesn't exist.")
EmptyExtractor = _error("EmptyExtractor", "A provenance has no extractor.")
InvalidSpan = _error("InvalidSpan", "A span has no file, or a position below 1, or ends before it starts.")
IndexCapacityExceeded = _error("IndexCapacityExceeded", "More elements than an index or a sequential kernel takes.")
InvalidTopologyEndpoint = _error("InvalidTopologyEndpoint", "An edge refers to a node outside the topology.")
ArithmeticOverflow = _error("ArithmeticOverflow", "A cost left its type, or is negative or not finite where it mustn't be.")
InvalidNodeIndex = _error("InvalidNodeIndex", "A node is outside a matrix.")
InvalidProbability = _error("InvalidProbability", "A probability has denominator zero or is above one.")
InvalidAlgorithmParameter = _error("InvalidAlgorithmParameter", "A parameter is outside its range.")
NegativeCycle = _error("NegativeCycle", "A negative cycle can be reached.")
CyclicGraph = _error("CyclicGraph", "The algorithm needs an acyclic graph.")
InvalidFormat = _error("InvalidFormat", "A text is not of the format.")
UnsupportedGraphFeature = _error("UnsupportedGraphFeature", "A format can't express the graph.")
PayloadCountMismatch = _error("PayloadCountMismatch", "There are more or fewer payloads than elements.")
InvalidStableKey = _error("InvalidStableKey", "A key is stale.")
MissingKeyedNode = _error("MissingKeyedNode", "An endpoint's key has no node.")
CycleWouldBeCreated = _error("CycleWouldBeCreated", "A change would close a cycle.")
