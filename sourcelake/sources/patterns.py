"""Architecture patterns: layers of folders with names and allowed dependencies, and rules over them.

The built-in ones are tables below; others come as mappings (``from_mapping``),
read from a JSON document or any other store of settings.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

RULE_TYPES = (
    "LAYER_DEPENDENCY", "NAMING_CONVENTION", "FILE_ORGANIZATION", "SINGLE_RESPONSIBILITY", "INTERFACE_SEGREGATION", "DEPENDENCY_INVERSION",
    "CYCLOMATIC_COMPLEXITY", "COGNITIVE_COMPLEXITY", "CODE_SMELL", "CIRCULAR_DEPENDENCY", "DEAD_CODE", "METHOD_LENGTH", "PARAMETER_COUNT", "COUPLING",
)


@dataclass(frozen=True)
class Layer:
    name: str
    globs: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    type: str
    config: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Pattern:
    name: str
    layers: tuple[Layer, ...] = ()
    rules: tuple[Rule, ...] = ()


def from_mapping(data: Mapping) -> Pattern:
    """A pattern from settings; a name is needed for it and for each layer, all else has defaults.

    An unknown severity is a warning, an unknown kind of rule is about the place of files.
    """

    def named(of: Mapping, what: str) -> str:
        if not isinstance(of.get("name"), str):
            raise ValueError(f"{what} has no name")
        return of["name"]

    def rule(of: Mapping) -> Rule:
        severity, kind = str(of.get("severity") or "").upper(), str(of.get("type") or "").upper()
        return Rule(of.get("id") or "", of.get("name") or "", severity if severity in ("ERROR", "INFO") else "WARNING", kind if kind in RULE_TYPES else "FILE_ORGANIZATION", of.get("config") or {})

    layers = tuple(Layer(named(x, "a layer"), tuple(x.get("file_patterns") or ()), tuple(x.get("naming_conventions") or ()), tuple(x.get("allowed_dependencies") or ())) for x in data.get("layers") or ())
    return Pattern(named(data, "a pattern"), layers, tuple(map(rule, data.get("rules") or ())))


def from_json(text: str) -> Pattern:
    return from_mapping(json.loads(text))


# Layers as name, folders, endings of file names, layers they may use; rules as id, name, severity, type, limits.
_LAYERS = {
    "MVC": (
        ("model", "model models entity entities domain", "Model Entity DTO Data Record", ""),
        ("view", "view views ui templates pages components", "View Page Component Template Screen Fragment", "model"),
        ("controller", "controller controllers handler handlers", "Controller Handler Action", "model view"),
    ),
    "Clean Architecture": (
        ("entity", "domain entity entities core/model", "Entity Aggregate ValueObject", ""),
        ("usecase", "usecase usecases interactor interactors application", "UseCase Interactor Service", "entity"),
        ("adapter", "adapter adapters controller controllers presenter gateway gateways", "Controller Presenter Gateway Adapter Mapper", "entity usecase"),
        ("infrastructure", "infrastructure infra framework config db external", "Impl Repository Client Config Driver", "entity usecase adapter"),
    ),
    "Repository Pattern": (
        ("repository-interface", "repository repositories port ports", "Repository Repo Port", ""),
        ("repository-impl", "repository/impl repositories/impl infrastructure/persistence data dao", "RepositoryImpl RepoImpl Dao DataSource", "repository-interface"),
        ("service", "service services usecase", "Service UseCase", "repository-interface"),
    ),
    "SOLID Principles": (),
    "Domain-Driven Design": (
        ("domain", "domain core", "Aggregate Entity ValueObject DomainEvent Event Specification Policy", ""),
        ("application", "application app command query", "Service Command CommandHandler Query QueryHandler", "domain"),
        ("infrastructure", "infrastructure infra persistence messaging", "Impl Repository Adapter Publisher Consumer", "domain application"),
        ("interface", "interface interfaces api rest graphql web", "Controller Resolver Resource Endpoint", "domain application"),
    ),
    "Hexagonal Architecture": (
        ("domain", "domain core core/model core/service", "Entity Aggregate ValueObject DomainService Policy Specification", ""),
        ("port-in", "port/in ports/in port/input ports/input port/driving usecase usecases", "UseCase Port InputPort Command Query", "domain"),
        ("port-out", "port/out ports/out port/output ports/output port/driven", "Port OutputPort Repository Gateway", "domain"),
        ("adapter-in", "adapter/in adapters/in adapter/driving adapter/web adapter/rest adapter/cli", "Controller Adapter Handler Consumer Listener", "domain port-in"),
        ("adapter-out", "adapter/out adapters/out adapter/driven adapter/persistence adapter/messaging adapter/external", "Adapter Impl Client Publisher Mapper", "domain port-out"),
    ),
    "CQRS Pattern": (
        ("command", "command commands write mutation", "Command CommandHandler CommandService Mutation WriteModel", "domain event"),
        ("query", "query queries read projection projections", "Query QueryHandler QueryService ReadModel Projection View", "domain event"),
        ("domain", "domain model models", "Entity Aggregate ValueObject", ""),
        ("event", "event events", "Event EventHandler EventListener Subscriber", "domain"),
    ),
    "Microservices Pattern": (
        ("api", "api rest grpc controller controllers endpoint", "Controller Resource Endpoint Request Response Dto DTO", "service domain"),
        ("service", "service services usecase", "Service UseCase Orchestrator", "domain repository client messaging"),
        ("domain", "domain model models entity", "Entity Model ValueObject Enum", ""),
        ("repository", "repository repositories dao persistence", "Repository Dao Store", "domain"),
        ("client", "client clients external integration", "Client Feign Proxy Integration", "domain"),
        ("messaging", "messaging event events kafka rabbitmq pubsub", "Producer Publisher Consumer Listener Subscriber Event", "domain"),
        ("config", "config configuration", "Config Configuration Properties", "domain service repository client messaging"),
    ),
    "Layered Architecture": (
        ("presentation", "presentation web controller controllers ui view views api", "Controller View Page Servlet Resource Dto DTO", "business common"),
        ("business", "business service services logic core", "Service Manager Processor Validator Calculator Engine", "data common"),
        ("data", "data dal dao repository repositories persistence", "Repository Dao Mapper Entity", "common"),
        ("common", "common shared util utils exception constant", "Util Utils Helper Constants Exception", ""),
    ),
    "Observer / Event-Driven": (
        ("event", "event events message messages", "Event Message Signal Notification", ""),
        ("publisher", "publisher emitter producer dispatcher", "Publisher Emitter Producer Dispatcher EventBus", "event"),
        ("subscriber", "subscriber listener handler consumer", "Subscriber Listener Handler Consumer Observer", "event"),
    ),
    "Factory / Creational Patterns": (),
    "Code Quality": (),
}
_MORE_NAMES = {("Repository Pattern", "repository-interface"): ("I.*Repository$",)}
_RULES = {
    "MVC": (
        ("mvc-layer-dep", "MVC Layer Dependency", "ERROR", "LAYER_DEPENDENCY", {}),
        ("mvc-naming", "MVC Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
        ("mvc-organization", "MVC File Organization", "INFO", "FILE_ORGANIZATION", {}),
    ),
    "Clean Architecture": (
        ("clean-layer-dep", "Clean Architecture Dependency Rule", "ERROR", "LAYER_DEPENDENCY", {}),
        ("clean-naming", "Clean Architecture Naming", "WARNING", "NAMING_CONVENTION", {}),
        ("clean-organization", "Clean Architecture File Organization", "INFO", "FILE_ORGANIZATION", {}),
    ),
    "Repository Pattern": (
        ("repo-dep-direction", "Repository Dependency Direction", "ERROR", "LAYER_DEPENDENCY", {}),
        ("repo-naming", "Repository Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
    ),
    "SOLID Principles": (
        ("solid-srp", "Single Responsibility Principle", "WARNING", "SINGLE_RESPONSIBILITY", {"max_methods_per_class": 10, "max_lines_per_class": 300}),
        ("solid-isp", "Interface Segregation Principle", "WARNING", "INTERFACE_SEGREGATION", {"max_interface_methods": 5}),
        ("solid-dip", "Dependency Inversion Principle", "INFO", "DEPENDENCY_INVERSION", {}),
        ("solid-method-complexity", "Method Complexity (SRP indicator)", "WARNING", "CYCLOMATIC_COMPLEXITY", {"max_cyclomatic_complexity": 10}),
        ("solid-method-length", "Method Length (SRP indicator)", "INFO", "METHOD_LENGTH", {"max_method_lines": 50}),
    ),
    "Domain-Driven Design": (
        ("ddd-layer-dep", "DDD Layer Dependency", "ERROR", "LAYER_DEPENDENCY", {}),
        ("ddd-naming", "DDD Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
        ("ddd-organization", "DDD File Organization", "INFO", "FILE_ORGANIZATION", {}),
    ),
    "Hexagonal Architecture": (
        ("hex-dep-direction", "Hexagonal Dependency Direction", "ERROR", "LAYER_DEPENDENCY", {}),
        ("hex-naming", "Hexagonal Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
        ("hex-organization", "Hexagonal File Organization", "INFO", "FILE_ORGANIZATION", {}),
        ("hex-dip", "Hexagonal Dependency Inversion", "WARNING", "DEPENDENCY_INVERSION", {}),
    ),
    "CQRS Pattern": (
        ("cqrs-separation", "CQRS Command/Query Separation", "ERROR", "LAYER_DEPENDENCY", {}),
        ("cqrs-naming", "CQRS Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
        ("cqrs-organization", "CQRS File Organization", "INFO", "FILE_ORGANIZATION", {}),
    ),
    "Microservices Pattern": (
        ("micro-dep-direction", "Microservice Dependency Direction", "ERROR", "LAYER_DEPENDENCY", {}),
        ("micro-naming", "Microservice Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
        ("micro-srp", "Service Single Responsibility", "WARNING", "SINGLE_RESPONSIBILITY", {"max_methods_per_class": 15, "max_lines_per_class": 400}),
    ),
    "Layered Architecture": (
        ("layered-dep", "Layer Dependency Direction", "ERROR", "LAYER_DEPENDENCY", {}),
        ("layered-skip", "No Layer Skipping", "WARNING", "LAYER_DEPENDENCY", {}),
        ("layered-naming", "Layered Architecture Naming", "WARNING", "NAMING_CONVENTION", {}),
        ("layered-organization", "Layered File Organization", "INFO", "FILE_ORGANIZATION", {}),
    ),
    "Observer / Event-Driven": (
        ("observer-decoupling", "Observer Decoupling", "ERROR", "LAYER_DEPENDENCY", {}),
        ("observer-naming", "Observer Naming Convention", "WARNING", "NAMING_CONVENTION", {}),
    ),
    "Factory / Creational Patterns": (
        ("factory-dip", "Factory Dependency Inversion", "WARNING", "DEPENDENCY_INVERSION", {}),
        ("factory-srp", "Factory Single Responsibility", "WARNING", "SINGLE_RESPONSIBILITY", {"max_methods_per_class": 8, "max_lines_per_class": 150}),
        ("factory-isp", "Factory Interface Segregation", "INFO", "INTERFACE_SEGREGATION", {"max_interface_methods": 3}),
        ("factory-complexity", "Factory Method Complexity", "WARNING", "CYCLOMATIC_COMPLEXITY", {"max_cyclomatic_complexity": 8}),
        ("factory-params", "Factory Parameter Count", "INFO", "PARAMETER_COUNT", {"max_parameters": 5}),
    ),
    "Code Quality": (
        ("quality-cyclomatic", "Cyclomatic Complexity", "WARNING", "CYCLOMATIC_COMPLEXITY", {"max_cyclomatic_complexity": 10}),
        ("quality-cognitive", "Cognitive Complexity", "WARNING", "COGNITIVE_COMPLEXITY", {"max_cognitive_complexity": 15}),
        ("quality-method-length", "Method Length", "WARNING", "METHOD_LENGTH", {"max_method_lines": 50}),
        ("quality-param-count", "Parameter Count", "WARNING", "PARAMETER_COUNT", {"max_parameters": 5}),
        ("quality-srp", "Single Responsibility", "WARNING", "SINGLE_RESPONSIBILITY", {"max_methods_per_class": 12, "max_lines_per_class": 300}),
        ("quality-coupling", "High Coupling", "INFO", "COUPLING", {"max_efferent_coupling": 10, "max_import_count": 15}),
    ),
}


def built_in() -> tuple[Pattern, ...]:
    """The twelve patterns; folders are globs of any depth, endings are expressions over whole names."""
    out = []
    for name, layers in _LAYERS.items():
        made = tuple(
            Layer(layer, tuple(f"**/{x}/**" for x in folders.split()), tuple(f".*{x}$" for x in endings.split()) + _MORE_NAMES.get((name, layer), ()), tuple(allowed.split()))
            for layer, folders, endings, allowed in layers
        )
        out.append(Pattern(name, made, tuple(Rule(*r) for r in _RULES[name])))
    return tuple(out)
