"""Dead code: what no root reaches, and how sure that is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import glob_regex
from graphloom.operators import graph
from graphloom.operators.spans import executed


@dataclass(frozen=True)
class Rule:
    """A framework keeps symbols alive: by decorator, by name, by file, or by id.

    A rule with ``packages`` holds where one of them is a dependency. ``names`` mean
    functions and methods, ``*`` stands for anything; every symbol of an entry file is kept.
    """

    name: str
    packages: tuple[str, ...] = ()
    decorators: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()


def _rule(name: str, packages: str, decorators: str = "", names: str = "", files: str = "") -> Rule:
    return Rule(name, *(tuple(x.split()) for x in (packages, decorators, names, files)))


#: What frameworks call by themselves.
RULES = (
    _rule(
        "nestjs", "@nestjs/core @nestjs/common",
        "Controller Injectable Module Resolver WebSocketGateway Catch Get Post Put Patch Delete All Options Head Sse Query Mutation Subscription ResolveField ResolveReference MessagePattern EventPattern SubscribeMessage OnEvent Cron Interval Timeout Processor Process",
        "onModuleInit onModuleDestroy onApplicationBootstrap beforeApplicationShutdown onApplicationShutdown canActivate intercept transform catch use validate afterInit handleConnection handleDisconnect",
    ),
    _rule(
        "angular", "@angular/core", "Component Directive Injectable NgModule Pipe HostListener Input Output",
        "ngOnInit ngOnDestroy ngOnChanges ngDoCheck ngAfterContentInit ngAfterContentChecked ngAfterViewInit ngAfterViewChecked transform canActivate canActivateChild canDeactivate canMatch resolve writeValue registerOnChange registerOnTouched setDisabledState intercept",
    ),
    _rule("typeorm", "typeorm", "Entity EventSubscriber BeforeInsert AfterInsert BeforeUpdate AfterUpdate BeforeRemove AfterRemove AfterLoad", "", "**/migrations/**/*.{ts,js}"),
    _rule("react", "react", "", "componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getSnapshotBeforeUpdate componentDidCatch getDerivedStateFromProps getDerivedStateFromError render"),
    _rule(
        "next", "next", "", "getServerSideProps getStaticProps getStaticPaths generateMetadata generateStaticParams generateViewport generateImageMetadata generateSitemaps",
        "{,src/}middleware.{ts,js} {,src/}instrumentation.{ts,js} **/pages/api/**/*.{ts,js}",
    ),
    _rule(
        "django", "django", "receiver register register.filter register.simple_tag register.inclusion_tag admin.register action api_view",
        "handle add_arguments ready dispatch get post put patch delete get_queryset get_object get_context_data get_serializer_class get_permissions form_valid form_invalid get_success_url perform_create perform_update perform_destroy has_permission has_object_permission clean clean_* validate validate_* to_representation to_internal_value save get_absolute_url __str__",
        "**/{admin,apps,models,urls,views,signals,settings,forms,serializers,tasks,context_processors}.py **/settings/*.py **/management/commands/*.py **/migrations/*.py **/templatetags/*.py",
    ),
    _rule("flask", "flask", "route get post put patch delete before_request after_request teardown_request teardown_appcontext errorhandler context_processor template_filter template_global cli.command before_app_request"),
    _rule("fastapi", "fastapi", "get post put patch delete options head api_route websocket on_event middleware exception_handler"),
    _rule("celery", "celery", "task shared_task periodic_task connect"),
    _rule("pytest", "pytest", "fixture pytest.fixture hookimpl", "pytest_*"),
    _rule("click", "click typer", "command group callback result_callback"),
    _rule("pydantic", "pydantic", "validator root_validator field_validator model_validator field_serializer model_serializer computed_field"),
    _rule("swift", "swift", "main objc objcMembers IBAction IBOutlet IBInspectable IBDesignable IBSegueAction NSManaged UIApplicationMain NSApplicationMain"),
    _rule("sqlalchemy", "sqlalchemy", "validates hybrid_property listens_for event.listens_for declared_attr"),
)


def active_rules(dependencies: set[str], own: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """The rules that hold for a project with these (lower-case) dependencies."""
    return tuple(r for r in (*RULES, *own) if not r.packages or any(p.lower() in dependencies for p in r.packages))


def confidence(exported: Column, named: Column, kind: Column, loc: Column) -> Column:
    """How sure an unreached symbol is dead."""
    c = F.lit(0.95) - F.when(exported, 0.25).otherwise(0) - F.when(named, 0.35).otherwise(0) - F.when(kind.isin("interface", "type"), 0.10).otherwise(0) - F.when(loc <= 2, 0.10).otherwise(0)
    return F.greatest(F.lit(0.05), F.floor(c * 100 + 0.5) / 100)


def rule_roots(symbols: DataFrame, facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, file, reason) of symbols that a framework rule keeps alive; the first rule wins."""
    deco = facts.where("tab = 'decorator'").select("file", F.col("a").alias("name"), F.col("b").alias("container"), F.col("c").alias("deco"), F.element_at(F.split("c", r"\."), -1).alias("last"))
    mark = symbols.join(deco, ["file", "name", "container"], "left")
    place = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        hit = F.col("id").isin(*r.symbols) if r.symbols else F.lit(False)
        if r.decorators:
            hit = hit | F.coalesce(F.col("last").isin(*r.decorators) | F.col("deco").isin(*r.decorators), F.lit(False))
        plain = [n for n in r.names if "*" not in n]
        named = F.col("name").isin(*plain) if plain else F.lit(False)
        for n in (n for n in r.names if "*" in n):
            named = named | F.col("name").rlike(glob_regex(n))
        hit = hit | (F.col("kind").isin("function", "method") & named)
        for g in r.files:
            hit = hit | F.col("file").rlike(glob_regex(g))
        place = F.when(hit, i).otherwise(place)
    first = mark.select("id", "file", place.alias("place")).where("place is not null").groupBy("id", "file").agg(F.min("place").alias("place"))
    reason = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("place") + 1) if rules else F.lit("")
    return first.select("id", "file", reason.alias("reason"))


def rule_effect(symbols: DataFrame, facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(reason, n): how many symbols each rule keeps alive, so that its effect is seen."""
    return rule_roots(symbols, facts, rules).groupBy("reason").agg(F.count("*").alias("n"))


def has_entry(files: DataFrame, entry: tuple[str, ...], public: tuple[str, ...]) -> bool:
    """Whether an entry or public glob means a file; without one, reachability says nothing."""
    globs = [glob_regex(g) for g in (*entry, *public)]
    return bool(globs) and not files.where(F.rlike("file", F.lit("|".join(globs)))).isEmpty()


def find_dead(g, stage, entry: tuple[str, ...] = (), public: tuple[str, ...] = (), coverage: DataFrame | None = None, data_names: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, file, name, kind, line, loc, score, verdict) of unreached symbols.

    ``entry`` and ``public`` are globs: all symbols of entry files, and exported
    ones of public files, are roots, with the public methods of the classes these
    reach; so are scripts, ``main`` of Go, modules that act on import but are never
    imported, rule matches, ambient declarations, and executed symbols, with the
    module of a file of which any line ran. ``verdict`` is *unknown* for what
    something may load by name, and for what only that reaches.
    """
    s, f = g.symbols, g.facts
    hit = lambda globs: F.rlike("file", F.lit("|".join(map(glob_regex, globs)) or r"\A\b\z"))
    at_start = s.where(hit(entry)).select("id")
    shown = s.where(hit(public) & F.col("exported")).select("id")
    script = f.where("tab = 'script'").select("file").distinct()
    main_pkg = f.where("tab = 'package' and a = 'main'").select("file").distinct()
    mains = s.join(main_pkg, "file", "left_semi").where("name = 'main'").select("id").unionByName(s.where("lang = 'go' and name = 'init'").select("id"))
    library = f.where("tab = 'package' and a <> 'main'").select("file").where("file not like '%_test.go' and not file rlike '(^|/)internal/'").distinct()
    api = s.join(library, "file", "left_semi").where("exported").select("id")
    tests = s.where("lang = 'go' and file like '%_test.go' or lang = 'swift' and file rlike 'Tests?/'").select("id")
    swift_api = s.where("lang = 'swift' and exported").select("id")
    modules = s.where("kind = 'module'").select("id", "file")
    imported = g.edges.where("kind = 'imports'").select(F.col("dst").alias("id")).distinct()
    pages = modules.where("file rlike '[.](mdx?|vue|svelte|astro|html)$'").select("id")
    acting = modules.join(imported, "id", "left_anti").join(f.where("tab = 'side_effects'").select("file").distinct(), "file", "left_semi")
    kept = rule_roots(s, f, rules)
    # the framework imported the file to find the symbol, so its top level ran
    kept = kept.select("id").unionByName(kept.select(F.concat("file", F.lit("#<module>")).alias("id")))
    roots = at_start.unionByName(shown).unionByName(mains).unionByName(api).unionByName(tests).unionByName(swift_api).unionByName(kept)
    # what is declared to be elsewhere is called there, and cannot be deleted here
    roots = roots.unionByName(s.join(f.where("tab = 'ambient'").select("file", F.col("a").alias("name"), F.col("b").alias("container")).distinct(), ["file", "name", "container"], "left_semi").select("id"))
    roots = roots.unionByName(pages).unionByName(modules.join(script, "file", "left_semi").select("id"))
    started = s.join(f.where("tab = 'script' and lang = 'swift'").select("file").distinct(), "file", "left_semi").where("kind = 'class'").select("id")
    roots = roots.unionByName(started).unionByName(s.join(acting.select("file"), "file", "left_semi").select("id"))
    if public:
        offered = s.where("kind = 'class'").join(graph.reachable(g.edges, shown, stage), "id", "left_semi").select("file", F.col("name").alias("container"))
        members = s.where("kind = 'method' and exported and name not rlike '^[#_]'").join(offered, ["file", "container"], "left_semi")
        roots = roots.unionByName(members.select("id"))
    watched = None
    if coverage is not None:
        ran = executed(s.select("file", "id", "line", "end_line"), coverage)
        roots = roots.unionByName(ran.select("id"))
        # a module has all the lines of its file
        roots = roots.unionByName(coverage.join(g.lengths, "file").where("line between 1 and lines").select(F.concat("file", F.lit("#<module>")).alias("id")).distinct())
        watched = coverage.select("file").distinct().withColumn("watched", F.lit(True))
    alive = stage.cut(graph.reachable(g.edges, roots.distinct(), stage))
    left = s.where("kind <> 'module'").join(alive, "id", "left_anti")
    strings = f.where("tab = 'string'").select(F.col("a").alias("name"), F.lit(True).alias("named")).distinct()
    left = left.join(strings, "name", "left").withColumn("named", F.coalesce("named", F.lit(False)))
    in_data = F.lit(False)
    if data_names is not None:  # a class that a data file names takes its members with it
        known = data_names.select("name").distinct()
        left = left.join(known.withColumn("in_data", F.lit(True)), "name", "left").join(known.select(F.col("name").alias("container"), F.lit(True).alias("around")), "container", "left")
        in_data = F.coalesce("in_data", F.lit(False)) | F.coalesce("around", F.lit(False))
    left = stage.cut(left.withColumn("by_name", F.col("named") | in_data))
    unsure = F.lit(False)
    if coverage is None:
        doubt = graph.reachable(g.edges, left.where("by_name").select("id"), stage).withColumn("doubt", F.lit(True))
        left = left.join(doubt, "id", "left")
        unsure = F.coalesce("doubt", F.lit(False))
    else:
        unsure = F.col("by_name")
    broken = f.where("tab = 'unparsed'").select("lang", F.lit(True).alias("broken")).distinct()
    left = left.join(broken, "lang", "left")
    base = confidence(F.col("exported"), F.col("named"), F.col("kind"), F.col("loc"))
    score = F.when(unsure, F.least(F.lit(0.45), base)).otherwise(base)
    verdict = F.when(unsure, "unknown").otherwise("dead")
    blind = F.coalesce("broken", F.lit(False))
    if watched is not None:
        left = left.join(watched, "file", "left")
        seen = F.coalesce("watched", F.lit(False))
        score, verdict, blind = F.when(seen, 0.97).otherwise(score), F.when(seen, "dead").otherwise(verdict), blind & ~seen
    score = F.when(blind, F.least(F.lit(0.6), score)).otherwise(score)
    return left.select("id", "file", "name", "kind", "line", "loc", score.alias("score"), verdict.alias("verdict"))


def findings(g, stage, files: DataFrame, entry: tuple[str, ...] = (), public: tuple[str, ...] = (), coverage: DataFrame | None = None, data_names: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kind, title, file, line, loc, score): dead symbols, and orphan files in place of theirs.

    Empty where no entry or public glob means a file. An orphan file has two
    symbols or more, none of them reached or uncertain, and nothing imports it;
    its lines are those of ``files`` (file, content).
    """
    empty = "id string, kind string, title string, file string, line int, loc int, score double"
    if not has_entry(files, entry, public):
        return files.sparkSession.createDataFrame([], empty)
    gone = stage.cut(find_dead(g, stage, entry, public, coverage, data_names, rules))
    said = g.symbols.where("kind <> 'module'").join(gone.select("id", "verdict"), "id", "left")
    said = said.select("file", "loc", F.col("verdict").isNull().alias("reached"), F.coalesce(F.col("verdict") == "unknown", F.lit(False)).alias("uncertain"))
    used = g.edges.where("kind = 'imports'").select(F.split(F.col("dst"), "#")[0].alias("file")).distinct()
    orphans = stage.cut(graph.orphan_files(said).join(used, "file", "left_anti"))
    lines = files.select("file", (F.size(F.split("content", "\n")).cast("int")).alias("loc"))
    whole = orphans.select("file").join(lines, "file").select(
        F.concat(F.lit("orphan-file:"), "file").alias("id"), F.lit("orphan-file").alias("kind"), F.concat(F.lit("Nothing in "), "file", F.lit(" is reachable")).alias("title"),
        "file", F.lit(1).alias("line"), "loc", F.lit(0.9).alias("score"),
    )
    title = F.when(F.col("verdict") == "unknown", F.concat("name", F.lit(" may be loaded by name"))).otherwise(F.concat("name", F.lit(" is never reached")))
    single = gone.join(orphans, "file", "left_anti").select(
        F.concat(F.lit("dead:"), "id").alias("id"), F.lit("dead").alias("kind"), title.alias("title"), "file", "line", F.col("loc").cast("int").alias("loc"), "score"
    )
    return whole.unionByName(single)
