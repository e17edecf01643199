"""Every operator under one roof, with the names that variants of an algorithm go by.

Variants that differ only in how a single process computes them (sequential or parallel, one or another augmenting rule)
are one plan here, so they are the same function.
"""

from lodestone.facade import NamedGraph
from lodestone.functions.filters import EdgeFilter
from lodestone.functions.generators import RandomGraphs, complete, complete_bipartite, cycle, grid, mesh, path, star
from lodestone.graph import EvidenceGraph, GraphBuilder, Topology
from lodestone.operators.cache import TraversalCache
from lodestone.operators.centrality import betweenness, center, closeness, diameter, distance_analytics, eccentricity, edge_betweenness, periphery, radius, undirected_edge_betweenness
from lodestone.operators.components import component_of, condensation, k_core, strongly_connected, weakly_connected
from lodestone.operators.dag import dag_longest_path, dag_longest_path_length, dag_reduction_closure, has_cycle, longest, topological, transitive_closure
from lodestone.operators.matrix import BitMatrix, DenseMatrix
from lodestone.operators.mutable import AcyclicGraph, KeyedGraph, StableGraph, WorkingGraph, fold_log, payload_topology, with_payload
from lodestone.operators.paths import all_pairs, all_pairs_auto, astar, bellman_ford, bellman_ford_measure, bidirectional_dijkstra, dijkstra, dijkstra_batch, dijkstra_measure, path_between, settled, spfa, sssp
from lodestone.operators.rank import degree_centrality, eigenvector_centrality, hits, katz_centrality, page_rank
from lodestone.operators.setops import complement, union, union_topologies
from lodestone.operators.spanning import bipartite_partition, forest_summary, graph_isomorphic, isomorphism_search, minimum_spanning_forest, prim_spanning_forest, subgraph_isomorphisms
from lodestone.operators.structure import (
    all_simple_paths,
    articulation_points,
    biconnected_components,
    bridges,
    chain_decomposition,
    cycle_basis,
    depth_first_search,
    dfs,
    dominance_frontiers,
    dominated_by,
    dominates,
    dominations,
    dominator_chain,
    dominators,
    dsatur,
    edmonds_karp,
    elementary_circuits,
    feedback_arc_set,
    find_cycle,
    k_shortest_paths,
    label_propagation,
    maximal_cliques,
    maximum_bipartite_matching,
    maximum_flow,
    maximum_matching,
    min_cost_max_flow,
    push_relabel,
    steiner_tree,
    stoer_wagner,
)
from lodestone.operators.traversal import bfs, bfs_batch, distances, reachable, shortest_path
from lodestone.sources.graph_json import from_json, read_json, read_parquet, to_json, topology_from_json, topology_to_json, write_parquet
from lodestone.sources.legacy import from_legacy
from lodestone.sources.text_formats import from_dot, from_graphml, read_graph6, read_graph_files, to_dot, to_graph6, to_graphml

floyd_warshall = johnson_all_pairs = johnson_all_pairs_parallel = all_pairs
bfs_batch_parallel, dijkstra_batch_parallel = bfs_batch, dijkstra_batch
closeness_parallel, betweenness_parallel, edge_betweenness_parallel = closeness, betweenness, edge_betweenness
kruskal, dinic = minimum_spanning_forest, maximum_flow
johnson_cycles, feedback_arc_set_heuristic, steiner_tree_approximation, dsatur_coloring = elementary_circuits, feedback_arc_set, steiner_tree, dsatur

__all__ = [name for name in dir() if not name.startswith("_")]
