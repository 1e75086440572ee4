"""Column builders: scalar functions of the engine, all inside Catalyst."""
