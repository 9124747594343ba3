"""The built-in vehicle profiles, as plain documents."""

from __future__ import annotations

# The profiles that come with the engine.

PROFILES = {
    "car": {
        "name": "car",
        "vehicleType": "motor_vehicle",
        "ignoreOneway": False,
        "speedMultiplier": 0.75,
        "accessTagKeys": ["access", "vehicle", "motor_vehicle"],
        "highway": {
            "motorway": {"speedKmh": 120, "access": "yes"},
            "motorway_link": {"speedKmh": 120, "access": "yes"},
            "trunk": {"speedKmh": 90, "access": "yes"},
            "trunk_link": {"speedKmh": 90, "access": "yes"},
            "primary": {"speedKmh": 90, "access": "yes"},
            "primary_link": {"speedKmh": 90, "access": "yes"},
            "secondary": {"speedKmh": 70, "access": "yes"},
            "secondary_link": {"speedKmh": 70, "access": "yes"},
            "tertiary": {"speedKmh": 70, "access": "yes"},
            "tertiary_link": {"speedKmh": 70, "access": "yes"},
            "unclassified": {"speedKmh": 50, "access": "yes"},
            "residential": {"speedKmh": 50, "access": "yes"},
            "service": {"speedKmh": 30, "access": "yes"},
            "track": {"speedKmh": 30, "access": "yes"},
            "road": {"speedKmh": 30, "access": "yes"},
            "living_street": {"speedKmh": 5, "access": "yes"},
            "footway": {"speedKmh": 5, "access": "no"},
            "path": {"speedKmh": 5, "access": "no"},
            "cycleway": {"speedKmh": 5, "access": "no"},
            "steps": {"speedKmh": 3, "access": "no"},
            "pedestrian": {"speedKmh": 5, "access": "no"},
            "bridleway": {"speedKmh": 5, "access": "no"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "delivery": "allow",
            "customers": "allow",
            "no": "deny",
            "private": "deny",
            "agricultural": "deny",
            "forestry": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 10, "access": "no"},
        "speedBounds": {"minKmh": 30, "maxKmh": 200},
        "difficulty": {
            "flooding": {"speedFactor": 0.3, "canPass": True},
            "liquefaction": {"speedFactor": 0.5, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.2, "canPass": True},
            "obstacle": {"speedFactor": 0.5, "canPass": True},
            "congestion": {"speedFactor": 0.4, "canPass": True},
            "snow": {"speedFactor": 0.4, "canPass": True},
            "ice": {"speedFactor": 0.3, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
    },
    "pedestrian": {
        "name": "pedestrian",
        "vehicleType": "foot",
        "ignoreOneway": True,
        "speedMultiplier": 1.0,
        "accessTagKeys": ["access", "foot"],
        "highway": {
            "motorway": {"speedKmh": 4, "access": "no"},
            "motorway_link": {"speedKmh": 4, "access": "no"},
            "trunk": {"speedKmh": 4, "access": "no"},
            "trunk_link": {"speedKmh": 4, "access": "no"},
            "primary": {"speedKmh": 4, "access": "yes"},
            "primary_link": {"speedKmh": 4, "access": "yes"},
            "secondary": {"speedKmh": 4, "access": "yes"},
            "secondary_link": {"speedKmh": 4, "access": "yes"},
            "tertiary": {"speedKmh": 4, "access": "yes"},
            "tertiary_link": {"speedKmh": 4, "access": "yes"},
            "unclassified": {"speedKmh": 4, "access": "yes"},
            "residential": {"speedKmh": 4, "access": "yes"},
            "service": {"speedKmh": 4, "access": "yes"},
            "track": {"speedKmh": 4, "access": "yes"},
            "road": {"speedKmh": 4, "access": "yes"},
            "living_street": {"speedKmh": 4, "access": "yes"},
            "footway": {"speedKmh": 4, "access": "yes"},
            "path": {"speedKmh": 4, "access": "yes"},
            "cycleway": {"speedKmh": 4, "access": "yes"},
            "steps": {"speedKmh": 2, "access": "yes"},
            "pedestrian": {"speedKmh": 4, "access": "yes"},
            "bridleway": {"speedKmh": 4, "access": "yes"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "no": "deny",
            "private": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 4, "access": "no"},
        "speedBounds": {"minKmh": 4, "maxKmh": 5},
        "difficulty": {
            "flooding": {"speedFactor": 0.1, "canPass": True},
            "liquefaction": {"speedFactor": 0.3, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.5, "canPass": True},
            "obstacle": {"speedFactor": 0.3, "canPass": True},
            "congestion": {"speedFactor": 0.9, "canPass": True},
            "snow": {"speedFactor": 0.5, "canPass": True},
            "ice": {"speedFactor": 0.4, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
    },
    "bicycle": {
        "name": "bicycle",
        "vehicleType": "bicycle",
        "ignoreOneway": False,
        "speedMultiplier": 1.0,
        "accessTagKeys": ["access", "vehicle", "bicycle"],
        "highway": {
            "motorway": {"speedKmh": 15, "access": "no"},
            "motorway_link": {"speedKmh": 15, "access": "no"},
            "trunk": {"speedKmh": 15, "access": "no"},
            "trunk_link": {"speedKmh": 15, "access": "no"},
            "primary": {"speedKmh": 15, "access": "yes"},
            "primary_link": {"speedKmh": 15, "access": "yes"},
            "secondary": {"speedKmh": 15, "access": "yes"},
            "secondary_link": {"speedKmh": 15, "access": "yes"},
            "tertiary": {"speedKmh": 15, "access": "yes"},
            "tertiary_link": {"speedKmh": 15, "access": "yes"},
            "unclassified": {"speedKmh": 15, "access": "yes"},
            "residential": {"speedKmh": 15, "access": "yes"},
            "service": {"speedKmh": 15, "access": "yes"},
            "track": {"speedKmh": 10, "access": "yes"},
            "road": {"speedKmh": 15, "access": "yes"},
            "living_street": {"speedKmh": 15, "access": "yes"},
            "footway": {"speedKmh": 5, "access": "yes"},
            "path": {"speedKmh": 15, "access": "yes"},
            "cycleway": {"speedKmh": 15, "access": "yes"},
            "steps": {"speedKmh": 5, "access": "yes"},
            "pedestrian": {"speedKmh": 5, "access": "yes"},
            "bridleway": {"speedKmh": 5, "access": "yes"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "no": "deny",
            "private": "deny",
            "agricultural": "deny",
            "forestry": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 5, "access": "no"},
        "speedBounds": {"minKmh": 5, "maxKmh": 25},
        "difficulty": {
            "flooding": {"speedFactor": 0.3, "canPass": True},
            "liquefaction": {"speedFactor": 0.3, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.4, "canPass": True},
            "obstacle": {"speedFactor": 0.4, "canPass": True},
            "congestion": {"speedFactor": 0.8, "canPass": True},
            "snow": {"speedFactor": 0.2, "canPass": True},
            "ice": {"speedFactor": 0.1, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
    },
    "truck": {
        "name": "truck",
        "vehicleType": "hgv",
        "ignoreOneway": False,
        "speedMultiplier": 0.75,
        "accessTagKeys": ["access", "vehicle", "motor_vehicle", "hgv"],
        "highway": {
            "motorway": {"speedKmh": 90, "access": "yes"},
            "motorway_link": {"speedKmh": 90, "access": "yes"},
            "trunk": {"speedKmh": 80, "access": "yes"},
            "trunk_link": {"speedKmh": 80, "access": "yes"},
            "primary": {"speedKmh": 80, "access": "yes"},
            "primary_link": {"speedKmh": 80, "access": "yes"},
            "secondary": {"speedKmh": 60, "access": "yes"},
            "secondary_link": {"speedKmh": 60, "access": "yes"},
            "tertiary": {"speedKmh": 50, "access": "yes"},
            "tertiary_link": {"speedKmh": 50, "access": "yes"},
            "unclassified": {"speedKmh": 40, "access": "yes"},
            "residential": {"speedKmh": 40, "access": "yes"},
            "service": {"speedKmh": 20, "access": "yes"},
            "track": {"speedKmh": 5, "access": "yes"},
            "road": {"speedKmh": 30, "access": "yes"},
            "living_street": {"speedKmh": 5, "access": "yes"},
            "footway": {"speedKmh": 5, "access": "no"},
            "path": {"speedKmh": 5, "access": "no"},
            "cycleway": {"speedKmh": 5, "access": "no"},
            "steps": {"speedKmh": 3, "access": "no"},
            "pedestrian": {"speedKmh": 5, "access": "yes"},
            "bridleway": {"speedKmh": 5, "access": "no"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "delivery": "allow",
            "customers": "allow",
            "no": "deny",
            "private": "deny",
            "agricultural": "deny",
            "forestry": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 10, "access": "no"},
        "speedBounds": {"minKmh": 5, "maxKmh": 90},
        "difficulty": {
            "flooding": {"speedFactor": 0.2, "canPass": True},
            "liquefaction": {"speedFactor": 0.3, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.2, "canPass": True},
            "obstacle": {"speedFactor": 0.4, "canPass": True},
            "congestion": {"speedFactor": 0.3, "canPass": True},
            "snow": {"speedFactor": 0.3, "canPass": True},
            "ice": {"speedFactor": 0.2, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
        "vehicleLimits": {"maxWeightTon": 20.0, "maxHeightMeter": 3.8, "maxWidthMeter": 2.5},
    },
    "ambulance": {
        "name": "ambulance",
        "vehicleType": "motor_vehicle",
        "ignoreOneway": True,
        "speedMultiplier": 0.75,
        "accessTagKeys": ["access", "vehicle", "motor_vehicle", "emergency"],
        "highway": {
            "motorway": {"speedKmh": 120, "access": "yes"},
            "motorway_link": {"speedKmh": 120, "access": "yes"},
            "trunk": {"speedKmh": 90, "access": "yes"},
            "trunk_link": {"speedKmh": 90, "access": "yes"},
            "primary": {"speedKmh": 90, "access": "yes"},
            "primary_link": {"speedKmh": 90, "access": "yes"},
            "secondary": {"speedKmh": 70, "access": "yes"},
            "secondary_link": {"speedKmh": 70, "access": "yes"},
            "tertiary": {"speedKmh": 70, "access": "yes"},
            "tertiary_link": {"speedKmh": 70, "access": "yes"},
            "unclassified": {"speedKmh": 50, "access": "yes"},
            "residential": {"speedKmh": 50, "access": "yes"},
            "service": {"speedKmh": 30, "access": "yes"},
            "track": {"speedKmh": 20, "access": "yes"},
            "road": {"speedKmh": 30, "access": "yes"},
            "living_street": {"speedKmh": 10, "access": "yes"},
            "footway": {"speedKmh": 10, "access": "yes"},
            "path": {"speedKmh": 10, "access": "yes"},
            "cycleway": {"speedKmh": 10, "access": "yes"},
            "steps": {"speedKmh": 3, "access": "no"},
            "pedestrian": {"speedKmh": 10, "access": "yes"},
            "bridleway": {"speedKmh": 10, "access": "yes"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "delivery": "allow",
            "customers": "allow",
            "official": "allow",
            "no": "deny",
            "private": "deny",
            "agricultural": "deny",
            "forestry": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 10, "access": "no"},
        "speedBounds": {"minKmh": 5, "maxKmh": 200},
        "difficulty": {
            "flooding": {"speedFactor": 0.4, "canPass": True},
            "liquefaction": {"speedFactor": 0.6, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.4, "canPass": True},
            "obstacle": {"speedFactor": 0.6, "canPass": True},
            "congestion": {"speedFactor": 0.6, "canPass": True},
            "snow": {"speedFactor": 0.5, "canPass": True},
            "ice": {"speedFactor": 0.4, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
        "vehicleLimits": {"maxWeightTon": 4.0, "maxHeightMeter": 2.6, "maxWidthMeter": 2.0},
    },
    "fire_engine": {
        "name": "fire_engine",
        "vehicleType": "motor_vehicle",
        "ignoreOneway": True,
        "speedMultiplier": 0.75,
        "accessTagKeys": ["access", "vehicle", "motor_vehicle", "hgv", "emergency"],
        "highway": {
            "motorway": {"speedKmh": 90, "access": "yes"},
            "motorway_link": {"speedKmh": 90, "access": "yes"},
            "trunk": {"speedKmh": 80, "access": "yes"},
            "trunk_link": {"speedKmh": 80, "access": "yes"},
            "primary": {"speedKmh": 80, "access": "yes"},
            "primary_link": {"speedKmh": 80, "access": "yes"},
            "secondary": {"speedKmh": 60, "access": "yes"},
            "secondary_link": {"speedKmh": 60, "access": "yes"},
            "tertiary": {"speedKmh": 50, "access": "yes"},
            "tertiary_link": {"speedKmh": 50, "access": "yes"},
            "unclassified": {"speedKmh": 40, "access": "yes"},
            "residential": {"speedKmh": 40, "access": "yes"},
            "service": {"speedKmh": 20, "access": "yes"},
            "track": {"speedKmh": 5, "access": "yes"},
            "road": {"speedKmh": 30, "access": "yes"},
            "living_street": {"speedKmh": 5, "access": "yes"},
            "footway": {"speedKmh": 5, "access": "yes"},
            "path": {"speedKmh": 5, "access": "yes"},
            "cycleway": {"speedKmh": 5, "access": "yes"},
            "steps": {"speedKmh": 3, "access": "no"},
            "pedestrian": {"speedKmh": 5, "access": "yes"},
            "bridleway": {"speedKmh": 5, "access": "no"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "delivery": "allow",
            "customers": "allow",
            "official": "allow",
            "no": "deny",
            "private": "deny",
            "agricultural": "deny",
            "forestry": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 10, "access": "no"},
        "speedBounds": {"minKmh": 5, "maxKmh": 90},
        "difficulty": {
            "flooding": {"speedFactor": 0.3, "canPass": True},
            "liquefaction": {"speedFactor": 0.4, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.4, "canPass": True},
            "obstacle": {"speedFactor": 0.5, "canPass": True},
            "congestion": {"speedFactor": 0.5, "canPass": True},
            "snow": {"speedFactor": 0.4, "canPass": True},
            "ice": {"speedFactor": 0.3, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
        "vehicleLimits": {"maxWeightTon": 8.0, "maxHeightMeter": 2.9, "maxWidthMeter": 2.1},
    },
    "disaster": {
        "name": "disaster",
        "vehicleType": "motor_vehicle",
        "ignoreOneway": False,
        "speedMultiplier": 0.75,
        "accessTagKeys": ["access", "vehicle", "motor_vehicle", "hgv", "emergency"],
        "highway": {
            "motorway": {"speedKmh": 90, "access": "yes"},
            "motorway_link": {"speedKmh": 90, "access": "yes"},
            "trunk": {"speedKmh": 80, "access": "yes"},
            "trunk_link": {"speedKmh": 80, "access": "yes"},
            "primary": {"speedKmh": 80, "access": "yes"},
            "primary_link": {"speedKmh": 80, "access": "yes"},
            "secondary": {"speedKmh": 60, "access": "yes"},
            "secondary_link": {"speedKmh": 60, "access": "yes"},
            "tertiary": {"speedKmh": 50, "access": "yes"},
            "tertiary_link": {"speedKmh": 50, "access": "yes"},
            "unclassified": {"speedKmh": 40, "access": "yes"},
            "residential": {"speedKmh": 40, "access": "yes"},
            "service": {"speedKmh": 20, "access": "yes"},
            "track": {"speedKmh": 10, "access": "yes"},
            "road": {"speedKmh": 30, "access": "yes"},
            "living_street": {"speedKmh": 10, "access": "yes"},
            "footway": {"speedKmh": 5, "access": "no"},
            "path": {"speedKmh": 5, "access": "no"},
            "cycleway": {"speedKmh": 5, "access": "no"},
            "steps": {"speedKmh": 3, "access": "no"},
            "pedestrian": {"speedKmh": 5, "access": "yes"},
            "bridleway": {"speedKmh": 5, "access": "no"},
        },
        "accessValueMap": {
            "yes": "allow",
            "permissive": "allow",
            "destination": "allow",
            "designated": "allow",
            "delivery": "allow",
            "customers": "allow",
            "official": "allow",
            "no": "deny",
            "private": "deny",
            "agricultural": "deny",
            "forestry": "deny",
        },
        "maxspeedTagKey": "maxspeed",
        "maxspeedUnitDefault": "kmh",
        "fallback": {"speedKmh": 10, "access": "no"},
        "speedBounds": {"minKmh": 5, "maxKmh": 90},
        "difficulty": {
            "flooding": {"speedFactor": 0.5, "canPass": True},
            "liquefaction": {"speedFactor": 0.6, "canPass": True},
            "landslide": {"speedFactor": 0.0, "canPass": False},
            "construction": {"speedFactor": 0.6, "canPass": True},
            "obstacle": {"speedFactor": 0.7, "canPass": True},
            "congestion": {"speedFactor": 0.5, "canPass": True},
            "snow": {"speedFactor": 0.6, "canPass": True},
            "ice": {"speedFactor": 0.5, "canPass": True},
        },
        "difficultyDefault": {"speedFactor": 1.0, "canPass": True},
        "vehicleLimits": {"maxWeightTon": 20.0, "maxHeightMeter": 3.8, "maxWidthMeter": 2.5},
    },
}
