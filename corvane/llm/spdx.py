"""Licence ids by what they allow, exceptions, and the phrases of their notices: the default vocabulary of the scan."""

from __future__ import annotations

ALLOW, REVIEW, DENY = 2, 1, 0

_ALLOWED = """
0BSD AAL Abstyles Adobe-2006 Adobe-Glyph ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 Afmparse AMDPLPA AML AMPAS ANTLR-PD Apache-1.0 Apache-1.1 Apache-2.0 APAFML App-s2p Artistic-2.0
Bahyph Barr Beerware Bitstream-Charter Bitstream-Vera Boehm-GC Borceux Brian-Gladman-3-Clause BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause
BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-Shortened BSD-4-Clause-UC BSD-4.3RENO BSD-4.3TAHOE
BSD-Attribution-HPND-disclaimer BSD-Source-Code BSL-1.0 bzip2-1.0.6 Caldera CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-PDDC CC0-1.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CFITSIO
ClArtistic CMU-Mach CNRI-Jython CNRI-Python Crossword CrystalStacker Cube curl diffmark DOC Dotseqn DSDP dtoa dvipdfm ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 eGenix Entessa EUDatagrid Fair FSFAP FSFUL FSFULLR
FTL GD Giftware Glulxe HPND HPND-sell-variant HTMLTIDY IBM-pibs ICU IJG ImageMagick Info-ZIP Intel ISC Jam JasPer-2.0 JPNIC JSON Latex2e Leptonica libpng-2.0 Libpng libtiff Linux-OpenIB LPL-1.02
MirOS MIT MIT-0 MIT-advertising MIT-CMU MIT-enna MIT-feh MIT-Festival MIT-Modern-Variant MIT-open-group MITNFA mpich2 MTLL MulanPSL-1.0 MulanPSL-2.0 Multics Mup Naumen NCSA Net-SNMP NetCDF Newsletr
NIST-PD NIST-PD-fallback NLOD-1.0 NLOD-2.0 Noweb NTP NTP-0 O-UDA-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGC-1.0 OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OLDAP-2.7 OLDAP-2.8 OML OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 Plexus
PostgreSQL psfrag psutils PSF-2.0 Python-2.0 Python-2.0.1 Qhull Rdisc RSA-MD Ruby Saxpath SCEA SGI-B-2.0 SMLNJ SNIA Spencer-86 Spencer-94 Spencer-99 SSH-OpenSSH SWL TCL TCP-wrappers TU-Berlin-1.0
TU-Berlin-2.0 UCAR UCL-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C W3C-19980720 W3C-20150513 Wsuipa WTFPL X11 XFree86-1.1 Xerox xinetd Xnet xpp Zed Zend-2.0 Zimbra-1.4
Zlib zlib-acknowledgement ZPL-1.1 ZPL-2.0 ZPL-2.1 BlueOak-1.0.0 Community-Spec-1.0 COIL-1.0 DL-DE-BY-2.0 etalab-2.0 Minpack SISSL-1.2
"""
_REVIEWED = """
APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Artistic-1.0 Artistic-1.0-cl8 Artistic-1.0-Perl BitTorrent-1.0 BitTorrent-1.1 CAL-1.0 CATOSL-1.1 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0
CDDL-1.0 CDDL-1.1 CDLA-Sharing-1.0 CECILL-B CECILL-C CECILL-2.0 CECILL-2.1 CERN-OHL-1.1 CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-W-2.0 Condor-1.1 CPAL-1.0 CPL-1.0 CUA-OPL-1.0 D-FSL-1.0 EPL-1.0 EPL-2.0 ErlPL-1.1 EUPL-1.0 EUPL-1.1
EUPL-1.2 Frameworx-1.0 FreeImage GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GFDL-1.1 GFDL-1.2 GFDL-1.3 gnuplot HPL-1.0 IPA IPL-1.0 Interbase-1.0 LAL-1.2 LAL-1.3 LGPL-2.0 LGPL-2.0+
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later LGPLLR LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a
LPPL-1.3c MakeIndex Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL NASA-1.3 NBPL-1.0 NGPL NOSL NPL-1.0 NPL-1.1 NPOSL-3.0 Nokia OCLC-2.0 ODbL-1.0 OGTSL OLDAP-1.1 OLDAP-2.0 OPL-1.0 OSET-PL-2.1
OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 PolyForm-Small-Business-1.0.0 QPL-1.0 RHeCos-1.1 RPSL-1.0 RSCPL SGI-B-1.0 SGI-B-1.1 SimPL-2.0 Sleepycat SPL-1.0 SugarCRM-1.1.3 SISSL TAPR-OHL-1.0 TMate TORQUE-1.1 TOSL
VOSTROM Watcom-1.0 wxWindows YPL-1.0 YPL-1.1 Zimbra-1.3 OGDL-Taiwan-1.0 Hippocratic-2.1
"""
_DENIED = """
AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BUSL-1.1 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0 CERN-OHL-S-2.0 CPOL-1.02
Elastic-2.0 GPL-1.0 GPL-1.0+ GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later NCGL-UK-2.0 Parity-6.0.0 Parity-7.0.0
PolyForm-Noncommercial-1.0.0 RPL-1.1 RPL-1.5 SSPL-1.0 LicenseRef-Proprietary LicenseRef-Commons-Clause
"""

#: Levels by id.
LICENCES = {name: level for level, names in ((ALLOW, _ALLOWED), (REVIEW, _REVIEWED), (DENY, _DENIED)) for name in names.split()}

EXCEPTIONS = """
389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception
Font-exception-2.0 freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception GPL-3.0-linking-source-exception GPL-CC-1.0 i2p-gpl-java-exception LGPL-3.0-linking-exception Libtool-exception
Linux-syscall-note LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0 openvpn-openssl-exception PS-or-PDF-font-exception-20170817
Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 SHL-2.0 SHL-2.1 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
""".split()

#: Licences by the phrases of their notices, lower-cased, white space collapsed.
NOTICES = {
    "mit license": "MIT", "mit licence": "MIT", "permission is hereby granted, free of charge": "MIT",
    "apache license, version 2.0": "Apache-2.0", "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache-2.0 license": "Apache-2.0", "apache software license, version 1.1": "Apache-1.1",
    "gnu general public license": "GPL-1.0-or-later",
    "gnu general public license, version 2": "GPL-2.0-only", "gnu general public license version 2": "GPL-2.0-only", "gnu general public license v2": "GPL-2.0-only", "gplv2": "GPL-2.0-only",
    "gnu general public license, version 3": "GPL-3.0-only", "gnu general public license version 3": "GPL-3.0-only", "gnu general public license v3": "GPL-3.0-only", "gplv3": "GPL-3.0-only",
    "gnu lesser general public license": "LGPL-2.1-or-later", "gnu library general public license": "LGPL-2.0-or-later", "gnu lesser general public license, version 3": "LGPL-3.0-only", "gnu lesser general public license version 3": "LGPL-3.0-only", "lgplv3": "LGPL-3.0-only",
    "gnu affero general public license": "AGPL-3.0-only", "gnu affero general public license, version 3": "AGPL-3.0-only", "agplv3": "AGPL-3.0-only", "gnu free documentation license": "GFDL-1.1-or-later",
    "mozilla public license": "MPL-2.0", "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license, v. 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0",
    "mozilla public license version 1.1": "MPL-1.1", "mozilla public license, version 1.1": "MPL-1.1", "mozilla public license 1.1": "MPL-1.1",
    "redistribution and use in source and binary forms": "BSD-3-Clause", "bsd 3-clause": "BSD-3-Clause", "3-clause bsd": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "bsd 2-clause": "BSD-2-Clause", "2-clause bsd": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause",
    "all advertising materials mentioning features or use of this software": "BSD-4-Clause",
    "isc license": "ISC", "permission to use, copy, modify, and/or distribute this software for any purpose": "ISC", "boost software license": "BSL-1.0",
    "zlib license": "Zlib", "the origin of this software must not be misrepresented": "Zlib", "altered source versions must be plainly marked as such": "Zlib", "sil open font license": "OFL-1.1", "open font license": "OFL-1.1",
    "common development and distribution license": "CDDL-1.0", "cddl version 1.1": "CDDL-1.1", "server side public license": "SSPL-1.0", "business source license": "BUSL-1.1", "elastic license 2.0": "Elastic-2.0", "commons clause": "LicenseRef-Commons-Clause",
    "python software foundation license": "PSF-2.0", "psf license agreement": "PSF-2.0", "do what the fuck you want to public license": "WTFPL", "wtfpl": "WTFPL", "artistic license 2.0": "Artistic-2.0", "artistic license": "Artistic-1.0",
    "eclipse public license": "EPL-2.0", "eclipse public license - v 1.0": "EPL-1.0", "eclipse public license v1.0": "EPL-1.0", "european union public licence": "EUPL-1.2", "common public license": "CPL-1.0", "microsoft public license": "MS-PL", "microsoft reciprocal license": "MS-RL",
    "postgresql license": "PostgreSQL", "php license": "PHP-3.01", "ruby license": "Ruby", "openssl license": "OpenSSL", "universal permissive license": "UPL-1.0", "academic free license": "AFL-3.0", "open software license": "OSL-3.0", "latex project public license": "LPPL-1.3c",
    "university of illinois/ncsa open source license": "NCSA", "open database license": "ODbL-1.0", "open data commons attribution license": "ODC-By-1.0", "public domain dedication and license": "PDDL-1.0", "open government licence v3.0": "OGL-UK-3.0", "mulan psl v2": "MulanPSL-2.0",
    "cc0 1.0": "CC0-1.0", "cc by 4.0": "CC-BY-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by-nd 4.0": "CC-BY-ND-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "creative commons attribution 4.0": "CC-BY-4.0", "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0", "creative commons attribution-sharealike 3.0": "CC-BY-SA-3.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0", "creative commons attribution 3.0": "CC-BY-3.0", "creative commons zero": "CC0-1.0", "the unlicense": "Unlicense", "released into the public domain": "CC-PDDC", "all rights reserved": "LicenseRef-Proprietary",
}
